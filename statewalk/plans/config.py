"""Settings of a full run, from a mapping (as read from YAML) with unknown keys refused."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


# The defaults of the sections below.


@dataclass
class Model:
    K: int = 6
    max_iter: int = 500
    seed: int = 42
    tr_sec: float = 0.72
    backend: str = "arhmm"
    ar_order: int = 1
    slds_latent_dim: int = 4


@dataclass
class Tests:
    n_perm_rm: int = 5000
    n_perm_between: int = 5000


@dataclass
class Evaluation:
    enabled: bool = False
    K_values: list[int] = field(default_factory=lambda: [2, 4, 6])
    seeds: list[int] = field(default_factory=lambda: [42])
    low_fo: float = 0.01
    short_dt: float = 2.0
    low_presence: float = 0.5
    dominant: float = 0.8
    ambiguous: float = 0.5
    clone_corr: float = 0.9
    run_len: int = 1200
    n_runs: int = 4


@dataclass
class Design:
    """contrast: a column of the design, or None for the default; demean: columns less their mean; state_major: rows by state."""

    contrast: str | None = None
    demean: list[str] = field(default_factory=list)
    include_fd: bool | None = None
    state_major: bool = False


@dataclass
class Parcels:
    """Permutation tests by parcel. one_sample: sign flips of the mean, else the two sexes. Keys of external programs are accepted."""

    enabled: bool = False
    n_perm: int = 5000
    two_tailed: bool = True
    one_sample: bool = False
    use_zscored: bool = True


@dataclass
class Parcellate:
    method: str = "MEAN"
    suffix: str = "REST_all_Yeo300"


@dataclass
class Quality:
    bins: int = 20


@dataclass
class Logging:
    format: str = "plain"
    level: str = "INFO"


#: How files write the settings of the detectors, of the parcel tests, and what they may hold that has no use here.
NESTED = {
    "junk": {"fo_median_min": "low_fo", "dt_mean_min_tr": "short_dt", "presence_min": "low_presence"},
    "indecision": {"dominance_thr": "dominant", "ambiguous_thr": "ambiguous"},
    "clone": {"corr_thr": "clone_corr"},
    "reliability": {"run_len_tr": "run_len", "n_runs": "n_runs"},
}
RENAMED = {"ise": "one_sample"}
UNUSED = {"evaluation": {"out_dir"}, "palm": {"tfce", "tfce2D", "cifti", "palm_bin"}, "group_design": {"subject_order_file"}}


@dataclass
class Config:
    hmm: Model = field(default_factory=Model)
    stats: Tests = field(default_factory=Tests)
    evaluation: Evaluation = field(default_factory=Evaluation)
    group_design: Design = field(default_factory=Design)
    palm: Parcels = field(default_factory=Parcels)
    parcellate: Parcellate = field(default_factory=Parcellate)
    qc: Quality = field(default_factory=Quality)
    logging: Logging = field(default_factory=Logging)
    paths: dict[str, str] = field(default_factory=dict)


def _build(kind: type, name: str, given: Any) -> Any:
    if given is None:
        return kind()
    if name == "evaluation" and isinstance(given, bool):
        given = {"enabled": given}
    flat: dict[str, Any] = {}
    for key, value in given.items():
        if name == "evaluation" and key in NESTED:
            wrong = sorted(set(value or {}) - set(NESTED[key]))
            if wrong:
                raise ValueError(f"unknown settings in {name}.{key}: {', '.join(wrong)}")
            flat |= {NESTED[key][k]: v for k, v in (value or {}).items()}
        elif key not in UNUSED.get(name, ()):
            flat[RENAMED.get(key, key)] = value
    wrong = sorted(set(flat) - {f.name for f in fields(kind)})
    if wrong:
        raise ValueError(f"unknown settings in {name}: {', '.join(wrong)}")
    return kind(**{k: [v] if k in ("K_values", "seeds", "demean") and not isinstance(v, list) else v for k, v in flat.items()})


def from_mapping(given: dict[str, Any]) -> Config:
    """Single numbers are accepted for K_values and seeds, and true for evaluation."""
    sections = {"hmm": Model, "stats": Tests, "evaluation": Evaluation, "group_design": Design, "palm": Parcels, "parcellate": Parcellate, "qc": Quality, "logging": Logging}
    wrong = sorted(set(given) - set(sections) - {"paths"})
    if wrong:
        raise ValueError(f"unknown sections: {', '.join(wrong)}")
    return Config(**{n: _build(kind, n, given.get(n)) for n, kind in sections.items()}, paths=dict(given.get("paths") or {}))


def from_yaml(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {})
