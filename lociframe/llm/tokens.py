"""Token ids of texts by a public word-level BPE file, fast enough for whole corpora.

The vocabulary's own pipeline (compose, lower-case, split by a pattern, merge
within a piece) has no dependence across pieces. So a text is split into pieces
here, and only pieces not met before go through the ``tokenizers`` model. The
memory of pieces is bounded; emptying it changes speed, not ids.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

#: Words and pieces of words that one worker remembers before it starts anew, some 200 bytes each,
#: and characters of the longest that is remembered between texts: at most some 90 MB a worker.
REMEMBERED, LONGEST = 400_000, 64
#: How the vocabulary splits a text into pieces, for
#: lower-cased Latin-1 characters.
SPLIT_LATIN = "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\t-\\r \\x85\\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
CONTROLS = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.np = np
        self.full = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.full.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.size = self.full.get_vocab_size()
        vocab = self.full.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.size, bool)  # the last id of each piece
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.special = tuple(t.content for t in self.full.get_added_tokens_decoder().values())
        self.latin = re.compile(SPLIT_LATIN).findall
        self.known: dict[str, bytes] = {}  # words, and pieces, which are words of one piece

    def split(self, word: str) -> list[str] | None:
        """Pieces of a word of Latin-1 characters; None for others, whose classes only the vocabulary knows."""
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return self.latin(word.lower())

    def learn(self, words: set[str]) -> None:
        """Ids of words not met before: split into pieces, and the new ones of these merged by the model."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        new = list(words.difference(self.known))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            pieces = [self.split(w) for w in part]
            self.merge(set(chain.from_iterable(filter(None, pieces))).difference(self.known))
            for word, x in zip(part, pieces):
                if x is None:
                    self.known[word] = self.whole(word)
                elif x != [word]:  # else it is there
                    self.known[word] = b"".join(map(self.known.__getitem__, x))

    def whole(self, text: str) -> bytes:
        return self.np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merge(self, pieces: set[str]) -> None:
        part = list(pieces)
        ids = self.np.array(self.pieces.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
        cuts = (self.np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) != len(part):
            raise ValueError("the vocabulary has no end-of-word ids")
        raw, start = ids.tobytes(), 0
        for piece, end in zip(part, cuts):
            self.known[piece] = raw[4 * start : 4 * end]
            start = end

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        try:  # fewer words to remember
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        # str.split() also parts at four control characters, which the vocabulary's pattern keeps in a piece.
        words = SPACES.split(text) if CONTROLS.search(text) else text.split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            out, step = [], REMEMBERED // 4
            for at in range(0, len(words), step):  # so that one text's words fit
                part = words[at : at + step]
                self.learn(set(part))
                out.append(b"".join(map(self.known.__getitem__, part)))
            long = [w for w in words if len(w) > LONGEST]
            if long:  # a few huge words would be most of what is remembered
                for word in {*long, *chain.from_iterable(self.split(w) or () for w in long)}:
                    self.known.pop(word, None)
            return b"".join(out)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)
