"""Reading and writing in one place: paths or texts in, structures, systems and files out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.options import BuildOptions
from molframe.plans.structure import Structure
from molframe.plans.system import System
from molframe.sinks import bundle
from molframe.sources import pdb


def read_pdb(spark: SparkSession, paths: str | list[str], options: BuildOptions | None = None) -> Structure:
    """Structures of PDB files, named by their files; the first problem is raised."""
    return Structure(pdb.parse(pdb.read_texts(spark, paths), options, strict=True))


def read_pdb_str(spark: SparkSession, named: dict[str, str], options: BuildOptions | None = None) -> Structure:
    """Structures of PDB texts by name."""
    return Structure(pdb.parse(pdb.texts(spark, named), options, strict=True))


def write_pdb(structure: Structure, folder: str | Path) -> list[Path]:
    """One file a structure in `folder`; a structure's text is on the driver one at a time."""
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    out = []
    for r in structure.to_pdb().toLocalIterator():
        (path := place / f"{r.sid}.pdb").write_text(r.text)
        out.append(path)
    return out


def _one(system: System, file: str) -> DataFrame:
    return bundle.texts(system).where(F.col("file") == file).select("sid", "text", "sha256")


def prmtop(system: System) -> DataFrame:
    """(sid, text, sha256) of the topology files."""
    return _one(system, "system.prmtop")


def inpcrd(system: System) -> DataFrame:
    return _one(system, "system.inpcrd")


def gromacs_top(system: System) -> DataFrame:
    return _one(system, "system.top")


def gro(system: System) -> DataFrame:
    return _one(system, "system.gro")
