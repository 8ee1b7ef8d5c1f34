"""Run configuration: TOML sections, with arguments taking precedence."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace

from ..functions.alleles import CallConfig
from ..operators.reads import ReadStructure


@dataclass(frozen=True)
class RunConfig:
    """Parameters of a run; fixed default values."""

    kmer_size: int = 31
    umi_length: int = 5
    skip_length: int = 2
    duplex: bool = True
    min_umi_quality: int = 20
    min_template_length: int | None = None
    min_family_size: int = 1
    max_hamming_distance: int = 1
    graph_min_molecules: int = 2
    max_paths: int = 100
    ti_position_tolerance: int = 0
    ti_rescue: bool = False
    output_format: str = "tsv"
    call: CallConfig = field(default_factory=CallConfig)

    @property
    def layout(self) -> ReadStructure:
        return ReadStructure(self.umi_length, self.skip_length)


def load_config(path: str | None = None, **given) -> RunConfig:
    """Values of a TOML file, whatever section they stand in, then the arguments that are not None."""
    raw = {}
    if path:
        with open(path, "rb") as f:
            for section in tomllib.load(f).values():
                raw.update(section if isinstance(section, dict) else {})
    raw |= {k: v for k, v in given.items() if v is not None}
    own = {f.name for f in fields(RunConfig)} - {"call"}
    calls = {f.name for f in fields(CallConfig)}
    config = RunConfig(**{k: v for k, v in raw.items() if k in own})
    return replace(config, call=config.call.merged(**{k: v for k, v in raw.items() if k in calls}))


def memory_shares(total: int) -> dict[str, int]:
    """A budget's parts in bytes: reads, index, paths."""
    return {"assembly": total * 25 // 100, "index": total * 60 // 100, "paths": total * 15 // 100}


def spark_memory(total: int) -> dict[str, str]:
    """Session settings for a budget."""
    mb = max(512, total >> 20)
    return {"spark.driver.memory": f"{mb}m", "spark.sql.shuffle.partitions": str(max(8, mb // 256))}
