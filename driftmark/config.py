"""Parameters with their defaults, and overrides from a mapping or a properties file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    max_page: int = 3
    min_count: int = 30
    min_tokens: int = 50
    min_distinct: int = 50
    runs: int = 1
    iterations: int = 25
    themes: int = 10
    lambda_background: float = 0.95
    theme_filter: float = 0.9
    threshold: float = 8.0
    log_max: float = 1000.0
    epsilon: float = 1e-7
    start: str = "1992-10-20"
    step_days: int = 5
    steps: int = 8
    total_variation: bool = False
    output: str = "graph.dot"
    max_pen_width: float = 3.0
    #: Begin (yyyy-MM-dd) of the frame whose words the HMM reads; none: all. Its length is hmm_days.
    hmm_start: str | None = None
    hmm_days: int = 20
    block_size: int = 65536
    #: Words of a block in decoding; none: the blocks of training, so that the stream is dealt once. The published default is 131072; results do not depend on it.
    viterbi_block_size: int | None = None
    # the published default is true, which gathers the whole stream on the driver
    force_sequential: bool = False
    #: Words times the square of states up to which a stream is trained on the driver.
    sequential_below: float = 5e7
    pi_threshold: float = 0.01
    a_threshold: float = 0.01
    max_iterations: int = 50

    def override(self, values: dict[str, str]) -> Params:
        """Values as text, by field name; unknown names are an error."""
        kinds = {f.name: int if f.name == "viterbi_block_size" else type(getattr(self, f.name)) for f in fields(self)}
        if unknown := set(values) - set(kinds):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        cast = lambda k, v: v.strip().lower() == "true" if kinds[k] is bool else (str if kinds[k] is type(None) else kinds[k])(v)
        return replace(self, **{k: cast(k, v) for k, v in values.items()})

    @classmethod
    def from_file(cls, path: str) -> Params:
        """A properties file (name=value lines, # comments); a missing file gives the defaults."""
        if not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8") as f:
            lines = [x.strip() for x in f if x.strip() and not x.lstrip().startswith("#")]
        return cls().override({k.strip(): v.strip() for k, v in (x.split("=", 1) for x in lines)})
