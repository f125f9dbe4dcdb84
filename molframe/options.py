"""Build options: defaults, validation, files, and command-line overrides."""

from __future__ import annotations

import dataclasses
import json
import math
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from molframe.errors import MolframeError


@dataclass
class BuildOptions:
    padding_angstrom: float = 12.0
    salt_molar: float = 0.15
    add_water: bool = True
    add_ions: bool = True
    seed: int = 0
    model: int = 1
    altloc: str | None = None
    #: State by CHAIN:NUMBER[CODE], for example {"A:42": "HID"}.
    protonation: dict[str, str] = field(default_factory=dict)
    overwrite: bool = False
    #: 1-4 scales of every torsion.
    scee: float = 1.2
    scnb: float = 2.0

    def validate(self) -> BuildOptions:
        if not (math.isfinite(self.padding_angstrom) and self.padding_angstrom > 0):
            raise MolframeError("invalid_option", "padding must be a positive finite value")
        if not (math.isfinite(self.salt_molar) and self.salt_molar >= 0):
            raise MolframeError("invalid_option", "salt concentration must be non-negative and finite")
        if self.add_ions and not self.add_water:
            raise MolframeError("invalid_option", "ions require water; disable both add_water and add_ions for a dry system")
        if self.model == 0:
            raise MolframeError("invalid_option", "PDB model numbers start at 1")
        return self

    @classmethod
    def from_mapping(cls, values: dict) -> BuildOptions:
        """Missing keys keep their defaults, unknown ones are ignored; protonation may be nested under `residues`."""
        known = {f.name for f in dataclasses.fields(cls)}
        got = {k: v for k, v in values.items() if k in known}
        if isinstance(got.get("protonation"), dict):
            got["protonation"] = dict(got["protonation"].get("residues", got["protonation"]))
        return cls(**got)

    @classmethod
    def from_file(cls, path: str | Path) -> BuildOptions:
        path = Path(path)
        kind = path.suffix.lower()
        if kind not in (".toml", ".json"):
            raise MolframeError("invalid_option", f"{path}: config file must use .toml or .json")
        try:
            text = path.read_text()
        except OSError as e:
            raise MolframeError("read", f"cannot read {path}: {e}") from e
        try:
            return cls.from_mapping(tomllib.loads(text) if kind == ".toml" else json.loads(text))
        except (ValueError, TypeError) as e:
            raise MolframeError("invalid_option", f"{path}: {e}") from e

    def overridden(self, *, model=None, altloc=None, protonation=None, padding=None, salt=None, no_water=False, no_ions=False, seed=None, overwrite=False) -> BuildOptions:
        """Flags over file values over defaults. A dry system has no ions either."""
        given = {"model": model, "altloc": altloc, "padding_angstrom": padding, "salt_molar": salt, "seed": seed}
        out = dataclasses.replace(self, **{k: v for k, v in given.items() if v is not None})
        out.protonation = {**self.protonation, **(protonation or {})}
        out.add_water = self.add_water and not no_water
        out.add_ions = self.add_ions and not (no_water or no_ions)
        out.overwrite = self.overwrite or overwrite
        return out


def parse_override(text: str) -> tuple[str, str]:
    """SELECTOR=STATE, the state in upper case."""
    selector, sign, state = text.partition("=")
    if not sign:
        raise ValueError("expected SELECTOR=STATE, for example A:42=HID")
    if not selector.strip() or not state.strip():
        raise ValueError("selector and state must both be non-empty")
    return selector.strip(), state.strip().upper()
