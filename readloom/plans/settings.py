"""Settings of the plans: explicit fields, and unknown keys are refused rather than dropped."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Self, get_type_hints

from readloom.schema import EXPECTED, OPTIONAL, REQUIRED


@dataclass(frozen=True)
class Settings:
    """A section: built from a mapping whose keys are its fields; sections within it are mappings themselves."""

    @classmethod
    def of(cls, values: dict) -> Self:
        if not isinstance(values, dict):
            raise ValueError(f"settings are a mapping, not {values!r}")
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(map(str, unknown)))}")
        kinds = get_type_hints(cls)

        def plain(name: str, value):
            if isinstance(kinds[name], type) and is_dataclass(kinds[name]):
                return kinds[name].of({} if value is None else value)
            return tuple(value) if isinstance(value, list) else value

        found = cls(**{k: plain(k, v) for k, v in values.items()})
        found.check()
        return found

    def check(self) -> None:
        """Raises a ValueError for values that can't be meant."""

    def _within(self, low: float, high: float, *names: str) -> None:
        for name in names:
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
                raise ValueError(f"{name} lies between {low} and {high}, not {value!r}")

    def _among(self, name: str, values: tuple) -> None:
        if getattr(self, name) not in values:
            raise ValueError(f"{name} is one of {', '.join(map(str, values))}, not {getattr(self, name)!r}")

    @classmethod
    def read(cls, text: str) -> Self:
        return cls.of(json.loads(text))

    @classmethod
    def read_yaml(cls, text: str) -> Self:
        """Settings as YAML, where a YAML library is installed; only plain values are built."""
        try:
            import yaml
        except ImportError as error:
            raise ValueError("settings as YAML need a YAML library; write them as JSON") from error
        return cls.of(yaml.safe_load(text) or {})

    @classmethod
    def load(cls, path: str) -> Self:
        """A file of JSON or YAML, by its ending."""
        ending = Path(path).suffix
        if ending not in (".json", ".yaml", ".yml"):
            raise ValueError(f"settings are a .json, .yaml or .yml file, not {path}")
        text = Path(path).read_text()
        return cls.read(text) if ending == ".json" else cls.read_yaml(text)

    def write(self) -> str:
        return json.dumps(asdict(self), indent=2)


@dataclass(frozen=True)
class DemuxSettings(Settings):
    expected: tuple[str, ...] = EXPECTED
    required: tuple[str, ...] = REQUIRED
    optional: tuple[str, ...] = OPTIONAL
    least_match: float = 0.8
    reverse: bool = True
    strict: bool = False
    least_confidence: float = 0.85
    #: Whether confidences come from probabilities (``probs``) or from raw scores (``logits``).
    scores: str = "probs"
    most_distance: int = 2
    #: Whether barcodes of reverse reads are turned before they are matched.
    turn_reverse: bool = False

    def check(self) -> None:
        self._within(0, 1, "least_match", "least_confidence")
        self._within(0, 1_000, "most_distance")
        self._among("scores", ("probs", "logits"))
        if missing := set(self.required) - set(self.expected):
            raise ValueError(f"required segments that aren't expected: {', '.join(sorted(missing))}")


@dataclass(frozen=True)
class MatrixSettings(Settings):
    """How a motif's matrix is made and used: tempered, kept from too low an entropy, or made of a pattern."""

    pattern: str | None = None
    pseudocount: float = 0.1
    temperature: float = 1.0
    least_entropy: float = 0.1
    least_score: float = 0.7

    def check(self) -> None:
        self._within(0, 1e6, "pseudocount")
        self._within(1e-6, 1e6, "temperature")
        self._within(0, 1, "least_entropy", "least_score")


@dataclass(frozen=True)
class LengthSettings(Settings):
    """Lengths that segments have to have, label: (least, most), and what a violation costs while it ramps up."""

    bounds: dict = field(default_factory=dict)
    weight: float = 1.0
    ramp: int = 0

    def check(self) -> None:
        for label, pair in self.bounds.items():
            if len(pair) != 2 or not 0 <= pair[0] <= pair[1]:
                raise ValueError(f"the length of {label} has a least and a most, in order: {pair!r}")
        self._within(0, 1e6, "weight", "ramp")


@dataclass(frozen=True)
class EnsembleSettings(Settings):
    """How models are combined, calibrated and doubted."""

    method: str = "bma"
    average: str = "probability"
    #: Of ``bma``: the prior of a model, the softmax's temperature, and the weight under which a model is dropped.
    prior: str = "uniform"
    prior_weights: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)
    temperature: float = 1.0
    least_weight: float = 0.0
    #: Of ``weighted_average``: given weights instead of searched ones.
    fixed: dict = field(default_factory=dict)
    folds: int = 5
    #: none, isotonic, platt or temperature.
    calibration: str = "none"
    level: float = 0.95
    draws: int = 100
    variance: bool = False
    intervals: bool = False

    def check(self) -> None:
        self._among("method", ("bma", "weighted_average", "voting", "stacking"))
        self._among("average", ("probability", "confidence", "logit", "rank"))
        self._among("prior", ("uniform", "informative", "adaptive"))
        self._among("calibration", ("none", "isotonic", "platt", "temperature"))
        self._within(1e-6, 1e9, "temperature")
        self._within(0, 1, "least_weight", "level")
        self._within(2, 1_000, "folds")
        self._within(1, 10_000, "draws")
        if self.prior == "informative" and not self.prior_weights:
            raise ValueError("an informative prior needs prior_weights")
        if self.prior == "adaptive" and not self.parameters:
            raise ValueError("an adaptive prior needs parameters")
        if self.method == "stacking" and (self.variance or self.intervals):
            raise ValueError("stacking has no weights to take variances and intervals from")


@dataclass(frozen=True)
class AllSettings(Settings):
    """A whole file: a section for each plan; sections that are left out have their defaults."""

    demux: DemuxSettings = DemuxSettings()
    matrix: MatrixSettings = MatrixSettings()
    lengths: LengthSettings = field(default_factory=LengthSettings)
    ensemble: EnsembleSettings = field(default_factory=EnsembleSettings)
