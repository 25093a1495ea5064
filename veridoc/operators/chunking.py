"""Chunking of a question and its answer: kept whole if short, else paragraphs packed to a size with a sentence of overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHOLE, PACK, OVERLAP, SHORT = 1300, 900, 300, 25
SLICE = 200  # documents cut together
CUTS = "؛،;,"
SENTENCE = re.compile(r"(?<=[.!?؟])\s+|\n+")


@lru_cache
def _piece(most: int) -> re.Pattern:
    """What one piece takes: up to the last mark that stands in the second half, else up to the last space, else all that fits."""
    return re.compile(rf"(?s:.{{{most // 2},{most - 1}}}[{CUTS}]|.{{1,{most - 1}}} |.{{{most}}})")


def split_long(text: str, most: int = PACK) -> list[str]:
    """Verbatim pieces of at most ``most`` characters."""
    out, text = [], text.strip()
    while len(text) > most:
        end = _piece(most).match(text).end()
        out.append(text[:end].strip())
        text = text[end:].strip()
    return [*out, text] if text else out


def sentences(text: str, least: int = SHORT) -> list[str]:
    """Sentences; one shorter than ``least`` joins the next, a short last one the one before."""
    out: list[str] = []
    for part in filter(None, map(str.strip, SENTENCE.split(text))):
        if out and len(out[-1]) < least:
            out[-1] += f" {part}"
        else:
            out.append(part)
    if len(out) > 1 and len(out[-1]) < least:
        last = out.pop()
        out[-1] += f" {last}"
    return out


def paragraphs(text: str, most: int = PACK) -> list[str]:
    """Paragraphs between blank lines; long ones as runs of sentences of at most ``most`` characters."""
    out: list[str] = []
    for paragraph in filter(None, map(str.strip, text.split("\n\n"))):
        whole = len(paragraph) <= most
        run = ""
        for piece in [paragraph] if whole else [p for s in sentences(paragraph) for p in split_long(s, most)]:
            if run and len(run) + 1 + len(piece) > most:
                out.append(run)
                run = ""
            run = f"{run} {piece}" if run else piece
        out += [run] if run else []
    return out


def chunk_text(answer: str | None, question: str | None = None, most: int = PACK) -> list[str]:
    """Chunks of a question and its answer; none if both are null or blank.

    The question is the first unit.  A chunk after the first begins with the last sentence of the unit before it, unless
    that sentence is longer than OVERLAP or the unit is the question.
    """
    question, answer = (question or "").strip(), answer or ""
    full = f"{question}\n\n{answer}".strip()
    if len(full) <= WHOLE:
        return [full] if full else []
    out: list[str] = []
    held: list[str] = []  # units of the open chunk, the overlap first
    own = 0  # those that are not overlap
    for unit in [question] * bool(question) + paragraphs(answer, most):
        if own and sum(len(u) + 2 for u in held) + len(unit) > most:
            out.append("\n\n".join(held))
            tail = sentences(held[-1])[-1:] if held[-1] != question else []
            held, own = [t for t in tail if len(t) <= OVERLAP], 0
        held.append(unit)
        own += 1
    return [*out, "\n\n".join(held)] if own else out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body", question_col: str | None = None) -> DataFrame:
    """(doc_id, ordinal, content) of every document; no shuffle.  A task holds the chunks of SLICE documents at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, texts, *asked = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                asked = asked[0] if asked else [None] * len(ids)
                rows = [(i, k, c) for i, t, q in zip(ids, texts, asked, strict=True) for k, c in enumerate(chunk_text(t, q))]
                own, ordinal, content = zip(*rows, strict=True) if rows else ((), (), ())
                columns = [pa.array(own, pa.int64()), pa.array(ordinal, pa.int32()), pa.array(content, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ordinal", "content"])

    asked = [F.col(question_col).alias("_asked")] if question_col else []
    used = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *asked)
    return used.mapInArrow(cut, "doc_id long, ordinal int, content string")
