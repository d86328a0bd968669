"""Structure texts: conversion between PDB and mmCIF atom records, and compression."""

from __future__ import annotations

import gzip
import re
import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# The atom fields that both forms share, as (mmCIF name, PDB columns from, to).
ATOM_FIELDS = (
    ("group_PDB", 0, 6), ("id", 6, 11), ("label_atom_id", 12, 16), ("label_alt_id", 16, 17), ("label_comp_id", 17, 20), ("label_asym_id", 21, 22), ("label_seq_id", 22, 26),
    ("pdbx_PDB_ins_code", 26, 27), ("Cartn_x", 30, 38), ("Cartn_y", 38, 46), ("Cartn_z", 46, 54), ("occupancy", 54, 60), ("B_iso_or_equiv", 60, 66), ("type_symbol", 76, 78),
)


def pdb_to_cif(text: str | None, name: str = "model") -> str | None:
    """The atoms of a PDB text as an mmCIF atom_site loop with model numbers; null stays null, no atoms give an empty loop."""
    if text is None:
        return None
    out = [f"data_{name}", "loop_", *[f"_atom_site.{n}" for n, _, _ in ATOM_FIELDS], "_atom_site.pdbx_PDB_model_num"]
    model = 1
    for line in text.splitlines():
        if line.startswith("MODEL"):
            model = int(line[5:].split()[0]) if line[5:].split() else model
        elif line.startswith(("ATOM", "HETATM")):
            values = [line[a:b].strip() or "." for _, a, b in ATOM_FIELDS]
            out.append(" ".join(f'"{v}"' if "'" in v else v for v in values) + f" {model}")
    return "\n".join([*out, "#", ""])


def cif_to_pdb(text: str | None) -> str | None:
    """The atom_site loop of an mmCIF text as PDB records, models apart; null stays null, no loop gives only END."""
    if text is None:
        return None
    names, rows = [], []
    for line in text.splitlines():
        if line.startswith("_atom_site."):
            names.append(line.split()[0].removeprefix("_atom_site."))
        elif names and (not line.strip() or line.startswith(("#", "_", "loop_", "data_"))):
            if rows:
                break
        elif names:
            values = shlex.split(line) if '"' in line or "'" in line else line.split()
            rows.append(dict(zip(names, values)))
    out, model = [], None
    many = len({r.get("pdbx_PDB_model_num", "1") for r in rows}) > 1
    get = lambda r, k, d="": d if r.get(k, ".") in (".", "?") else r[k]
    for r in rows:
        if many and r.get("pdbx_PDB_model_num") != model:
            if model is not None:
                out.append("ENDMDL")
            model = r.get("pdbx_PDB_model_num")
            out.append(f"MODEL     {model:>4}")
        atom = get(r, "label_atom_id")
        atom = atom if len(atom) > 3 else f" {atom}"
        x, y, z = (float(get(r, k, "0")) for k in ("Cartn_x", "Cartn_y", "Cartn_z"))
        occ, b = float(get(r, "occupancy", "1")), float(get(r, "B_iso_or_equiv", "0"))
        out.append(f"{get(r, 'group_PDB', 'ATOM'):<6}{get(r, 'id', '0'):>5} {atom:<4}{get(r, 'label_alt_id'):1}{get(r, 'label_comp_id'):>3} {get(r, 'label_asym_id', 'A')[:1]}{get(r, 'label_seq_id', '1'):>4}{get(r, 'pdbx_PDB_ins_code'):1}   {x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{b:6.2f}          {get(r, 'type_symbol'):>2}")
    if many:
        out.append("ENDMDL")
    return "\n".join([*out, "END", ""])


def structure_format(text: str | None) -> str | None:
    """'cif' or 'pdb', by what the text looks like."""
    if text is None:
        return None
    return "cif" if re.match(r"\s*data_", text) or "_atom_site." in text else "pdb"


def _series(f, kind):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return lambda c: F.pandas_udf(run, kind)(c)


def to_cif(c: Column) -> Column:
    """A column of PDB or mmCIF texts as mmCIF."""
    return _series(lambda t: t if structure_format(t) == "cif" else pdb_to_cif(t), StringType())(c)


def to_pdb(c: Column) -> Column:
    """A column of PDB or mmCIF texts as PDB."""
    return _series(lambda t: t if structure_format(t) == "pdb" else cif_to_pdb(t), StringType())(c)


def compress(c: Column, level: int = 6) -> Column:
    """Texts as gzip bytes, the same for the same text. (Parquet's own codec mostly makes this needless.)"""
    return _series(lambda t: gzip.compress(t.encode(), level, mtime=0), BinaryType())(c)


def decompress(c: Column) -> Column:
    return _series(lambda b: gzip.decompress(b).decode(), StringType())(c)
