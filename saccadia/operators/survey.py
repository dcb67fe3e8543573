"""Cleaning of questionnaire answers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.operators.matrix import drop_sparse_columns, drop_sparse_rows

# Questions asked in two wordings; the first wording stays.
REWORDED_QUESTIONS = {
    "synsskarphed:2": ["Jeg oplever, at skarpheden af synet ændrer sig eller varierer i løbet af dagen",
                       "Jeg oplever, at skarpheden af synet varierer i løbet af dagen"],
    "synskomfort:2": ["Jeg oplever udtrætning / ømhed af øjnene efter at have brugt dem en hel dag",
                      "Jeg oplever udtrætning eller ømhed af øjnene efter at have brugt dem en hel dag"],
    "lysfolsomhed:1": ["Udendørs lys opleves for skarpt – jeg bliver nødt til at bruge solbriller",
                       "Udendørs lys blænder – jeg bliver nødt til at bruge solbriller"],
    "lysfolsomhed:2": ["Jeg oplever, at lys fra billygter i mørke blænder / er ubehageligt",
                       "Jeg oplever, at lys fra billygter i mørke blænder eller er ubehageligt"],
    "movement:1": ["Jeg undgår større forsamlinger / kan ikke klare steder, der ”ser travle ud”",
                   "Jeg undgår situationer med mange synsindtryk"],
    "movement:6": ["Min balance bliver påvirket, når jeg ser til siden under gang eller cykling",
                   "Min balance bliver påvirket, når jeg ser til siden under gang eller når jeg cykler"],
    "reading:1": ["Min koncentrationsevne er påvirket / jeg distraheres nemt ved læsning",
                  "Min koncentrationsevne er påvirket ved læsning"],
    "reading:6": ["Jeg mister læsestedet / må bruge fingeren for ikke at miste læsestedet",
                  "Jeg mister læsestedet ved læsning"],
    "reading:7": ["Jeg har begrænset udholdenhed ved læsning på papir eller andet nærarbejde (fx håndarbejde eller lignende)",
                  "Jeg har begrænset udholdenhed ved synskrævende aktiviteter tæt på"],
    "screen:3": ["Jeg har svært ved / generes af at læse undertekster på tv", "Jeg har svært ved at læse undertekster på tv"],
}

# Questions that patients and controls answer in separate columns.
CONTROL_QUESTIONS = {f"rivermead_{part}:{n}": [f"rivermead_{part}:{n}", f"rivermead_{part}_control:{n}"]
                     for part in (1, 2) for n in range(8)}
# Fixed value: a quoted answer code inside a list literal such as ['1', '3'].
QUOTED = """['"]([^'"]*)['"]"""
META_COLUMNS = ["category", "date", "id", "version"]


def merge_questions(df: DataFrame, variants: dict[str, Sequence[str]]) -> DataFrame:
    """First answer among the variants of a question under the target name; the other variants are dropped."""
    present = {t: [v for v in vs if v in df.columns] for t, vs in variants.items()}
    present = {t: vs for t, vs in present.items() if vs}
    merged = df.withColumns({t: F.coalesce(*[F.col(f"`{v}`") for v in vs]) for t, vs in present.items()})
    gone = {v for vs in present.values() for v in vs} - set(present)
    return merged.select(*[F.col(f"`{c}`") for c in merged.columns if c not in gone])


def rename_topics(df: DataFrame, meta: Sequence[str] = META_COLUMNS) -> DataFrame:
    """``topic:N_question text`` becomes ``topic:N``."""
    return df.toDF(*[c if c in meta else re.sub(r"(:[0-9])_.*", r"\1", c, count=1, flags=re.S) for c in df.columns])


def latest_per_id(df: DataFrame, key: str = "id", date: str = "date", ties: Sequence[str] = ()) -> DataFrame:
    """The row with the latest date of every id, a missing date counting as oldest.

    An aggregate instead of a row number: the map side keeps one candidate per id, so a hot id stays small.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(key).agg(F.max_by(row, F.struct(F.col(date), *[F.col(t) for t in ties])).alias("_row"))
    return best.select("_row.*")


def topic_columns(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns by topic: a column belongs to every topic whose name it contains."""
    topics = sorted({c.split(":")[0] for c in columns})
    return {t: [c for c in columns if t in c] for t in topics}


def category_code(df: DataFrame, column: str = "category") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == "PATIENT", 1).when(F.col(column) == "CONTROL", 0))


def multi_hot(df: DataFrame, column: str, prefix: str, drop: Sequence[str] = (),
              codes: Sequence[str] | None = None) -> DataFrame:
    """List literal in a text column to one 0/1 column per answer code; ``codes`` names them or they are looked up."""
    answers = F.regexp_extract_all(F.col(f"`{column}`"), F.lit(QUOTED), 1)
    parsed = df.withColumn("_answers", answers)
    if codes is None:  # as many as there are answer options
        codes = sorted(r["c"] for r in parsed.select(F.explode("_answers").alias("c")).distinct().collect())
    out = parsed.withColumns({f"{prefix}{c}": F.coalesce(F.array_contains("_answers", c), F.lit(False)).cast("int")
                              for c in codes if c not in drop})
    return out.drop("_answers", column)


def reworded_variants() -> dict[str, list[str]]:
    """Column names of both wordings by the column that stays."""
    named = {code: [f"{code}_{text}" for text in texts] for code, texts in REWORDED_QUESTIONS.items()}
    return {columns[0]: columns for columns in named.values()}


def clean_survey(df: DataFrame, column_share: float = 0.60, row_share: float = 0.10, pain: str = "pain:0",
                 dropped_pain: Sequence[str] = ("6",)) -> DataFrame:
    """From raw answers to one row per id: wordings and control columns merged, the latest answers kept, sparse columns
    and rows dropped, category as 0/1, pain answers as 0/1 columns."""
    merged = merge_questions(rename_topics(merge_questions(df, reworded_variants())), CONTROL_QUESTIONS)
    dense = drop_sparse_rows(drop_sparse_columns(latest_per_id(merged), column_share), row_share)
    return multi_hot(category_code(dense), pain, "pain:", dropped_pain)
