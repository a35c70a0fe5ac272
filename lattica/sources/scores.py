"""Readers of notation files: XML scores to rows of notes, token text to rows of tokens."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = "path string, part_idx int, part_id string, m_idx int, number string, divisions int, n_idx int, onset_n long, onset_d long, dur_n long, dur_d long, voice string, staff int, step string, alter double, octave int, rest boolean, chord boolean, grace boolean, note_type string, dots int, error string"


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A row for each note of each partwise XML file. Onsets and durations are exact, in quarters. A file that can't be parsed gives one row with ``error``."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_scores, NOTES)


def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in NOTES.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                rows = [{"path": path} | r for r in notes_of(bytes(content))]
            except (ET.ParseError, ValueError, ZeroDivisionError) as e:
                rows = [{"path": path, "error": str(e)}]
            if rows:
                yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)


def notes_of(content: bytes) -> Iterator[dict]:
    """The notes of one score. backup and forward move the cursor; a chord note starts with the note before it; grace notes take no time."""
    root = ET.fromstring(content)
    if root.tag != "score-partwise":
        raise ValueError(f"not a partwise score: {root.tag}")
    for p, part in enumerate(root.findall("part")):
        divisions = 1
        for m, measure in enumerate(part.findall("measure")):
            at = before = Fraction(0)
            n = 0
            for e in measure:
                if e.tag == "attributes":
                    divisions = int(e.findtext("divisions") or divisions)
                length = Fraction(e.findtext("duration") or 0) / divisions
                if e.tag == "backup":
                    at = max(Fraction(0), at - length)
                elif e.tag == "forward":
                    at += length
                elif e.tag == "note":
                    chord, grace, pitch = e.find("chord") is not None, e.find("grace") is not None, e.find("pitch")
                    start = before if chord else at
                    yield {
                        "part_idx": p, "part_id": part.get("id"), "m_idx": m, "number": measure.get("number"), "divisions": divisions, "n_idx": n,
                        "onset_n": start.numerator, "onset_d": start.denominator, "dur_n": length.numerator, "dur_d": length.denominator,
                        "voice": e.findtext("voice"), "staff": int(e.findtext("staff") or 1), "step": pitch.findtext("step") if pitch is not None else None,
                        "alter": float(pitch.findtext("alter") or 0) if pitch is not None else None, "octave": int(pitch.findtext("octave")) if pitch is not None else None,
                        "rest": e.find("rest") is not None, "chord": chord, "grace": grace, "note_type": e.findtext("type"), "dots": len(e.findall("dot")),
                    }
                    n += 1
                    if not chord and not grace:
                        before, at = at, at + length


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, kind, value of the white-space separated tokens ``kind-value``; a token without - has a null value. Null texts give no row."""
    words = docs.select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit(r"(\S+)"))).alias("pos", "token"))
    return words.select(id_col, "pos", F.substring_index("token", "-", 1).alias("kind"), F.when(F.instr("token", "-") > 0, F.expr("substring(token, instr(token, '-') + 1)")).alias("value"))


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes as Parquet, a folder a part position, so that readers of one part prune the others."""
    notes.write.mode("overwrite").partitionBy("part_idx").parquet(path)
