"""Reading level of documents: share of words outside a list of familiar words, and sentence length.

The familiar words are those that at least a given share of the documents with running prose use; the list is
derived from document frequencies over the whole corpus, and its size is bounded by the mean number of different
words of a document divided by that share. Each sentence gets the two parts of the formula, the share of its words
outside the list and its length; a small grid over the two, counted over graded documents, says how often each
level writes such sentences. A document's level is the likeliest one given all its sentences, so that a stray
sentence weighs as little as such strays do in the graded documents. That is a classifier over the formula's parts;
the formula by itself, a weighted sum of them per document, is `formula_reading`, and `held_out` compares both. Code, logs, headings, places and other
material is taken out before, and never enters a word count.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import Scratch

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_ITEM = re.compile(r"(?:[-*+•]|\d{1,3}[.)])\s+")
#: Marks of lines that are code, log, data or an address rather than prose.
_CODE = re.compile(r"[={}\[\]|<>]|\)\s*:?$|;$|^(?:def|return|import|class|if|for|while)\b.*[:\]]$|://")
_END = re.compile(r"(?<=[.!?])[\"')]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Marks of a footnote or a source, which are part of no word.
_CITATION = re.compile(r"\[\d{1,3}(?:[,;–-] ?\d{1,3})*\]")
_EDGES = ".,;:!?\"'()*_“”‘’﻿"
_SPACES = " \t\xa0﻿​"
MIN_WORDS, MIN_SENTENCES = 3, 4


def prose_sentences(text: str | None) -> list[list[str]]:
    """The sentences of running prose, each as its plain words in lower case.

    Fenced code, tags, headings and lines that look like code, logs or data are left out and end a paragraph, as do
    blank lines; wrapped lines are joined, list items stand alone. A sentence ends with a full stop, a question or
    an exclamation mark, has at least three plain words, and at least two for each identifier, path or number,
    which count as no words. Null and blank texts have none.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "```" in text:
        text = _FENCE.sub("\n\n", text)
    out: list[list[str]] = []
    paragraph: list[str] = []

    def close() -> None:
        if not paragraph:
            return
        for sentence in _END.split(" ".join(paragraph)):
            sentence = sentence.strip()
            if not sentence or sentence[-1] not in ".!?":
                continue
            words, others = [], 0
            for token in sentence.lower().split():
                token = token.strip(_EDGES)
                if _WORD.fullmatch(token):
                    words.append(token)
                elif token:
                    others += 1
            if len(words) >= MIN_WORDS and len(words) >= 2 * others:
                out.append(words)
        paragraph.clear()

    for line in text.splitlines():
        line = line.strip(_SPACES)
        if not line or line[0] == "#":
            close()
            continue
        if m := _ITEM.match(line):
            close()
            line = line[m.end() :]
        if "[" in line:
            line = _CITATION.sub("", line)
        if _CODE.search(line.replace("()", "")):
            close()
        else:
            paragraph.append(line)
    close()
    return out


def prose(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, prose) of the documents with at least four sentences: words apart by blanks, sentences by line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = prose_sentences(t.as_py())
                if len(s) >= MIN_SENTENCES:
                    ids.append(i)
                    texts.append("\n".join(map(" ".join, s)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "prose"])

    return documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, prose string")


def familiar_words(texts: DataFrame, share: float) -> list[str]:
    """The words that at least `share` of the documents use, in order. At most the mean number of different words a
    document has, divided by `share`; no word of a rarer kind leaves the executors."""
    n = texts.count()
    words = texts.select(F.explode(F.array_distinct(F.split("prose", "[ \n]"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    return sorted(r.w for r in words.where(F.col("df") >= share * n).select("w").collect()) if n else []


#: The grid: steps of the share of unfamiliar words, and of the logarithm of the sentence's length.
SHARE_STEPS, LENGTH_STEPS, LENGTH_MAX = 20, 8, 40


def cell(unfamiliar: int, words: int) -> int:
    return int(SHARE_STEPS * unfamiliar / words) * LENGTH_MAX + min(int(LENGTH_STEPS * math.log(words)), LENGTH_MAX - 1)


def measures(texts: DataFrame, familiar: list[str]) -> DataFrame:
    """Per document: sentences, share of unfamiliar words, mean sentence length, and the grid cell of each sentence."""
    known = frozenset(familiar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t in b.column(1):
                n = new = 0
                cells = []
                for s in t.as_py().split("\n"):
                    words = s.split(" ")
                    u = sum(w not in known for w in words)
                    n, new = n + len(words), new + u
                    cells.append(cell(u, len(words)))
                for column, v in zip(out, (len(cells), new / n, n / len(cells), cells)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.list_(pa.int32()))], ["doc_id", "sentences", "unfamiliar_share", "sentence_length", "cells"])

    return texts.mapInArrow(run, "doc_id bigint, sentences int, unfamiliar_share double, sentence_length double, cells array<int>")


def votes_of(labels: DataFrame, doc_id: str, level: str, levels: int) -> DataFrame:
    """(doc_id, level) of every grade, repeated ones once; null grades and those out of range are none."""
    rows = labels.where(F.col(level).between(1, levels) & F.col(doc_id).isNotNull())
    return rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(level).alias("level"), *[c for c in ("grader",) if c in labels.columns]).distinct().select("doc_id", "level")


def level_grid(measured: DataFrame, labels: DataFrame, doc_id: str, level: str, levels: int, smooth: float = 0.02) -> np.ndarray | None:
    """Log likelihood of each grid cell per level, from all graded documents; each document weighs its votes, each
    sentence of it alike. The table of counts is as large as the grid, whatever the corpus. None without grades."""
    votes = votes_of(labels, doc_id, level, levels)
    counts = measured.select("doc_id", "cells").join(votes, "doc_id").select("level", F.explode("cells").alias("cell")).groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    grid = np.full((levels, (SHARE_STEPS + 1) * LENGTH_MAX), smooth)
    for r in counts:
        grid[r.level - 1, r.cell] += r.n
    return np.log(grid / grid.sum(1, keepdims=True))


@dataclass
class Formula:
    """score = share * unfamiliar share + length * mean sentence length + constant; a level begins at its cut."""

    share: float
    length: float
    constant: float
    cuts: list[float]


def fit_formula(measured: DataFrame, labels: DataFrame, doc_id: str, level: str, levels: int) -> Formula | None:
    """The weights of the two parts by least squares over all grades, and cuts half way between the mean scores of
    neighbouring levels. Only sums per level come to the driver. None without grades of at least three documents."""
    g = measured.join(votes_of(labels, doc_id, level, levels), "doc_id").select("level", F.col("unfamiliar_share").alias("s"), F.col("sentence_length").alias("n"))
    rows = g.groupBy("level").agg(F.count(F.lit(1)).alias("c"), *[F.sum(x).alias(f"x{k}") for k, x in enumerate((F.col("s"), F.col("n"), F.col("s") * F.col("s"), F.col("n") * F.col("n"), F.col("s") * F.col("n")))]).collect()
    if sum(r.c for r in rows) < 3:
        return None
    c, s, n, ss, nn, sn = (sum(r[k] for r in rows) for k in ("c", "x0", "x1", "x2", "x3", "x4"))
    y = [sum(r.level * r[k] for r in rows) for k in ("x0", "x1", "c")]
    share, length, constant = (float(x) for x in np.linalg.lstsq(np.array([[ss, sn, s], [sn, nn, n], [s, n, c]]), np.array(y), rcond=None)[0])
    mean = {r.level: (share * r.x0 + length * r.x1) / r.c + constant for r in rows}
    known = sorted(mean)
    cuts = []
    for k in range(2, levels + 1):  # a level nobody gave has the cut of the next one above
        below, above = [x for x in known if x < k], [x for x in known if x >= k]
        cuts.append((mean[below[-1]] + mean[above[0]]) / 2 if below and above else (-np.inf if not below else np.inf))
    return Formula(share, length, constant, [float(x) for x in np.maximum.accumulate(cuts)])


def formula_levels(measured: DataFrame, formula: Formula | None) -> DataFrame:
    """Adds `score` and `level` by the formula, as expressions; both null without one."""
    if formula is None:
        return measured.select("*", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("level"))
    d = measured.withColumn("score", F.lit(formula.share) * F.col("unfamiliar_share") + F.lit(formula.length) * F.col("sentence_length") + F.lit(formula.constant))
    level = F.lit(1)
    for cut in formula.cuts:
        level = level + (F.col("score") >= F.lit(cut)).cast("int")
    return d.withColumn("level", level)


def levels_of(measured: DataFrame, grid: np.ndarray | None) -> DataFrame:
    """Adds `level`, null where nothing was graded; equal likelihoods go to the easier level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(4)
            level = [None if grid is None else int(grid[:, c.values.to_numpy()].sum(1).argmax()) + 1 for c in cells]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(level, pa.int32())], ["doc_id", "sentences", "unfamiliar_share", "sentence_length", "level"])

    return measured.mapInArrow(run, "doc_id bigint, sentences int, unfamiliar_share double, sentence_length double, level int")


def english(lang: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(lang), F.lit(" \t\r\n"))).rlike("^en([-_].*)?$"), F.lit(False))


#: Shares of documents that must use a word to make it familiar: for the grid, and for the formula by itself.
GRID_SHARE, FORMULA_SHARE = 0.1, 0.2


def reading_levels(documents: DataFrame, labels: DataFrame, scratch: Scratch, familiar_share: float = GRID_SHARE, levels: int = 4) -> DataFrame:
    """(doc_id, sentences, unfamiliar_share, sentence_length, level) of the English documents with running prose.

    Documents without a language, id or prose are no rows; a doc_id that occurs twice is measured twice. Repeated
    and null grades count once and not at all.
    """
    texts = scratch.keep(prose(documents.where(english("lang")), "doc_id", "text"))
    measured = scratch.keep(measures(texts, familiar_words(texts, familiar_share)))
    return levels_of(measured, level_grid(measured, labels, "doc_id", "level", levels))


def formula_reading(documents: DataFrame, labels: DataFrame, scratch: Scratch, familiar_share: float = FORMULA_SHARE, levels: int = 4) -> DataFrame:
    """(doc_id, sentences, unfamiliar_share, sentence_length, score, level) by the formula alone."""
    texts = scratch.keep(prose(documents.where(english("lang")), "doc_id", "text"))
    measured = scratch.keep(measures(texts, familiar_words(texts, familiar_share)).drop("cells"))
    return formula_levels(measured, fit_formula(measured, labels, "doc_id", "level", levels))


def held_out(documents: DataFrame, labels: DataFrame, scratch: Scratch, levels: int = 4, parts: int = 10, tested: int = 3) -> DataFrame:
    """(graders, documents, grid, formula): of the graded documents held out, those that so many graders gave one level, all
    alike, and how many of them the grid and the formula put there. The other documents' grades alone were learned from;
    a hash of the id decides, `tested` of `parts`. Familiar words are counted over all documents, graded or not."""
    out = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(parts)) < tested
    learned = labels.where(F.col("doc_id").isNotNull() & ~out)
    by = lambda f, name: f(documents, learned, scratch, levels=levels).select("doc_id", F.col("level").alias(name))
    alike = votes_of(labels.where(out), "doc_id", "level", levels).groupBy("doc_id").agg(F.count(F.lit(1)).alias("graders"), F.min("level").alias("level"), F.max("level").alias("most")).where("level = most")
    j = alike.join(by(reading_levels, "g"), "doc_id").join(by(formula_reading, "f"), "doc_id")
    return j.groupBy("graders").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("g") == F.col("level")).alias("grid"), F.count_if(F.col("f") == F.col("level")).alias("formula"))
