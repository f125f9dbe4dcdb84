"""Files of prepared systems: their texts as a table, and folders with a manifest.

Folders are written by tasks in two jobs: lines stream into staged files, then each system's files are renamed onto
their places, the manifest last. The folder must be one that all executors share, or the address of a file system.
Parquet tables (System.write) are the output for many systems.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.errors import MolframeError
from molframe.plans.system import System
from molframe.runtime import cut
from molframe.sinks import render, sections

FILES = ["system.prmtop", "system.inpcrd", "system.top", "system.gro"]
#: Columns and order of the rows that the renderers take.
ORDER = {"atoms": ["atom_idx"], "residues": ["residue"], "bonds": ["i", "j"], "angles": ["j", "i", "k"], "dihedrals": ["ord"], "exclusions": ["i", "j"]}


#: The tables that each file is made of.
OF = {"system.prmtop": list(ORDER), "system.inpcrd": ["atoms"], "system.top": ["atoms", "residues", "bonds", "angles", "dihedrals"], "system.gro": ["atoms", "residues"]}


def _nested(s: System, tables: list[str]) -> DataFrame:
    """One row a system with each of the tables as a sorted array of structs."""
    out = s.info
    for name, order in ((n, o) for n, o in ORDER.items() if n in tables):
        t = getattr(s, name)
        rest = [c for c in t.columns if c not in ("sid", *order)]
        rows = t.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(rows, "sid", "left")
    return out


def texts(s: System, files: list[str] | None = None) -> DataFrame:
    """(sid, file, text, sha256) of each of `files` (all four by default) of every system; tables that none of them is made of are not read."""
    wanted = files or FILES
    tables = [n for n in ORDER if any(n in OF[f] for f in wanted)]
    write = {
        "system.prmtop": lambda t, row: render.topology(t["atoms"], t["residues"], t["bonds"], t["angles"], t["dihedrals"], t["exclusions"], row),
        "system.inpcrd": lambda t, row: render.coordinates(t["atoms"], row),
        "system.top": lambda t, row: render.gromacs_topology(t["atoms"], t["residues"], t["bonds"], t["angles"], t["dihedrals"]),
        "system.gro": lambda t, row: render.gro(t["atoms"], t["residues"], row),
    }

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                t = {k: [] if row[k] is None else list(row[k]) for k in tables}
                made = {f: write[f](t, row) for f in wanted}
                yield pd.DataFrame({"sid": row["sid"], "file": list(made), "text": list(made.values()), "sha256": [hashlib.sha256(v.encode()).hexdigest() for v in made.values()]})

    return _nested(s, tables).mapInPandas(run, "sid string, file string, text string, sha256 string")


def places(folder: str | Path, ids: list[str], overwrite: bool = False) -> dict[str, Path]:
    """The folder of each system; one that holds generated files is refused without `overwrite`."""
    out = {sid: Path(folder) if len(ids) == 1 else Path(folder) / sid for sid in sorted(ids)}
    for place in out.values():
        if not overwrite and any((place / n).exists() for n in [*FILES, "manifest.json"]):
            raise MolframeError("output_exists", f"{place} has generated files; allow overwriting or name another folder")
    return out


def _root(folder: str | Path) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder: a path, or an address such as hdfs://."""
    name = str(folder)
    return fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), os.path.abspath(name))


def _there(at: fs.FileSystem, path: str) -> bool:
    return at.get_file_info(path).type != fs.FileType.NotFound


def _put(at: fs.FileSystem, staged: str, place: str, overwrite: bool) -> None:
    """Rename a staged file onto its place. A repeated attempt finds the staged file gone and its place filled, and leaves both.
    Without `overwrite` a place that is filled by another is an error."""
    if not _there(at, staged):
        if not _there(at, place):
            raise MolframeError("output_lost", f"{place} and its staged file are both gone")
        return
    if _there(at, place):
        if not overwrite:
            raise MolframeError("output_exists", f"{place} was written by another")
        at.delete_file(place)
    at.move(staged, place)


def _stage(folder: str, run: str):
    """Lines in order into a file for each (sid, file); an attempt's files have names of their own, and only rows of finished attempts are seen."""

    def write(batches):
        at, root = _root(folder)
        key = out = told = path = None
        size = 0
        for pdf in batches:
            for now, part in pdf.groupby(["sid", "file"], sort=False):
                if now != key:
                    if out is not None:
                        out.close()
                        yield pd.DataFrame([(*key, path, size, told.hexdigest())], columns=STAGED)
                    key, told, size = now, hashlib.sha256(), 0
                    path = f"{root}/.staged-{run}/{uuid.uuid4().hex}"
                    at.create_dir(os.path.dirname(path), recursive=True)
                    out = at.open_output_stream(path)
                data = "".join(x + "\n" for x in part["text"]).encode()
                out.write(data)
                told.update(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame([(*key, path, size, told.hexdigest())], columns=STAGED)

    return write


#: What is known of a staged file.
STAGED = ["sid", "file", "path", "bytes", "sha256"]


def commit_bundles(s: System, reports: DataFrame, folder: str | Path, overwrite: bool = False) -> DataFrame:
    """(sid, folder) of the folders written under `folder`; with a single system its files go into `folder` itself.

    Lines are sorted by file and streamed by tasks, so no text is held whole; the staged files are then renamed by a task for each
    group of systems, the manifest last: a folder with a manifest is whole. Lost tasks are repeated with staged files of their own.
    If any folder holds generated files, all are refused without `overwrite`, before anything is written."""
    name, run = str(folder), uuid.uuid4().hex
    single = s.info.select("sid").limit(2).count() == 1

    def place(root: str, sid: str) -> str:
        return root if single else f"{root}/{sid}"

    def filled(batches):
        at, root = _root(name)
        for pdf in batches:
            yield pdf[[any(_there(at, f"{place(root, x)}/{n}") for n in [*FILES, "manifest.json"]) for x in pdf["sid"]]]

    if not overwrite:
        taken = s.info.select("sid").mapInPandas(filled, "sid string").limit(1).collect()
        if taken:
            raise MolframeError("output_exists", f"{place(name, taken[0].sid)} has generated files; allow overwriting or name another folder")
    s, key = s.kept(), ["sid", "file"]
    rows = sections.lines(s).repartition(*key).sortWithinPartitions(*key, *sections.KEY).select(*key, "text")
    staged = cut(rows.mapInPandas(_stage(name, run), "sid string, file string, path string, bytes long, sha256 string"))

    def rename(batches):
        at, root = _root(name)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                to, files = place(root, r.sid), {f["file"]: f for f in r.files}
                at.create_dir(to, recursive=True)
                for f in FILES:
                    _put(at, files[f]["path"], f"{to}/{f}", overwrite)
                report = json.loads(r.report) | {"output_sha256": {f: files[f]["sha256"] for f in FILES}}
                beside = f"{root}/.staged-{run}/{uuid.uuid4().hex}"
                with at.open_output_stream(beside) as out:
                    out.write((json.dumps(report, indent=2, sort_keys=True) + "\n").encode())
                at.move(beside, f"{to}/manifest.json")
            yield pd.DataFrame({"sid": pdf["sid"], "folder": [place(name, x) for x in pdf["sid"]]})

    told = reports.select("sid", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))
    files = staged.groupBy("sid").agg(F.collect_list(F.struct("file", "path", "sha256")).alias("files"))
    done = cut(files.join(told, "sid").mapInPandas(rename, "sid string, folder string"))
    at, root = _root(name)
    if _there(at, f"{root}/.staged-{run}"):
        at.delete_dir(f"{root}/.staged-{run}")
    return done


def write_bundles(s: System, reports: DataFrame, folder: str | Path, overwrite: bool = False) -> list[Path]:
    """The folders of `commit_bundles`, in order of their systems."""
    return [Path(r.folder) for r in commit_bundles(s, reports, folder, overwrite).orderBy("sid").toLocalIterator()]
