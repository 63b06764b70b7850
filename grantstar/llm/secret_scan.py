"""Secret scans: fixed patterns, and character Markov models for keys that no pattern knows.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a string whose log-likelihood ratio is high enough is taken for a secret.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantstar.llm.common import stored
from grantstar.llm.tasks import map_slices

KINDS = ("assign", "access", "hex", "random")

#: The shapes of well-known secrets.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

#: Characters of a string that may be a key, and the fewest of them.
KEY_CHARACTERS = r"[A-Za-z0-9+/_=-]"
KEY_LENGTH = 16
#: Log-likelihood ratio (natural log) for a whole string, and on average for each character step.
TOTAL_RATIO, STEP_RATIO = 20.0, 0.75

_SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("end", T.LongType(), False),
    ]
)
_STRING = T.StructType(
    [
        T.StructField("label", T.IntegerType()),
        T.StructField("start", T.LongType(), False),
        T.StructField("value", T.StringType(), False),
    ]
)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret value) of the fixed patterns, by start, then kind."""
    found = [
        (m.start(), 0, m.end(), m[2])
        for m in re.finditer(ASSIGN, text, re.ASCII | re.IGNORECASE)
        if len(m[2]) >= ASSIGN_VALUE
    ]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(ACCESS, text) if len(m[0]) >= ACCESS_LENGTH]
    # Runs of hex digits are maximal, so only runs that are long enough need to be looked at.
    for m in re.finditer(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LENGTH},}}", text):
        found.append((m.start(), 2, m.end(), m[0]))
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """(start, string) of key-shaped strings that no fixed pattern touches; numbers and rules without a letter
    are no keys."""
    out, ahead, reach = [], 0, 0
    ends = sorted((s, e) for s, _, e, _ in spans)
    for m in re.finditer(rf"{KEY_CHARACTERS}{{{KEY_LENGTH},}}", text):
        # Strings and spans ascend: of the spans that begin before the end of a string only the furthest end counts.
        while ahead < len(ends) and ends[ahead][0] < m.end():
            reach = max(reach, ends[ahead][1])
            ahead += 1
        if reach <= m.start() and re.search("[A-Za-z]", m[0]):
            out.append((m.start(), m[0]))
    return out


#: The alphabet of the models; anything else is one more character.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 2  # other characters, and the edge of a string
_CODE = {c: i for i, c in enumerate(ALPHABET)}


def steps(value: str) -> list[int]:
    """Character pairs of a string as numbers, the edge before and after it included."""
    codes = [SIZE - 1, *(_CODE.get(c, SIZE - 2) for c in value), SIZE - 1]
    return [a * SIZE + b for a, b in zip(codes, codes[1:])]


@dataclass(frozen=True)
class KeyModels:
    """Log-likelihood ratio of each character step, random string against ordinary identifier."""

    ratio: np.ndarray

    @classmethod
    def trained(cls, counts: np.ndarray) -> KeyModels:
        """``counts`` (2, SIZE * SIZE): steps of identifiers and of random strings. Each row of a model is
        smoothed by its share of the model's plain character frequencies, those by one count each."""
        logs = []
        for table in counts.reshape(2, SIZE, SIZE).astype(float):
            plain = (table.sum(0) + 1) / (table.sum() + SIZE)
            logs.append(np.log((table + 5 * plain) / (table.sum(1, keepdims=True) + 5)))
        return cls((logs[1] - logs[0]).ravel())

    def score(self, value: str) -> tuple[float, float]:
        """Ratio of the whole string, and on average for a step."""
        each = self.ratio[steps(value)]
        return float(each.sum()), float(each.mean())

    def is_random(self, value: str) -> bool:
        total, mean = self.score(value)
        return total >= TOTAL_RATIO and mean >= STEP_RATIO


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and the strings the models look at: labelled 1 (values of fixed patterns) or
    null (key-shaped strings elsewhere)."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("base", T.ArrayType(_SPAN, False), False),
            T.StructField("strings", T.ArrayType(_STRING, False), False),
        ]
    )

    def make():
        def work(columns):
            out = [columns[0], [], []]
            for text in columns[1]:
                text = text or ""
                spans = base_spans(text)
                out[1].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e, _ in spans])
                strings = [{"label": 1, "start": s, "value": v} for s, _, _, v in spans]
                strings += [{"label": None, "start": s, "value": v} for s, v in candidates(text, spans)]
                out[2].append(strings)
            return out

        return work

    return map_slices(docs.select("doc_id", "text"), make, schema)


def labelled_samples(found: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """value, label: the training strings.

    Without ``examples`` (value, label 0 or 1) the corpus labels itself: values of fixed patterns are random
    strings, and key-shaped strings of letters only, apart from a capital in front, are identifiers.
    """
    if examples is not None:
        return examples.select("value", F.col("label").cast("int"))
    each = found.select(F.explode("strings").alias("s")).select("s.value", "s.label")
    plain = F.col("label").isNull() & F.col("value").rlike(r"^[A-Za-z]?[a-z]+([_-][a-z]+)*$")
    return each.where((F.col("label") == 1) | plain).select(
        "value", F.when(F.col("label") == 1, 1).otherwise(0).alias("label")
    )


def train(samples: DataFrame) -> KeyModels:
    """Character steps are counted over all samples; the driver gets at most 2 * SIZE * SIZE counts."""
    schema = T.StructType(
        [
            T.StructField("label", T.IntegerType(), False),
            T.StructField("step", T.IntegerType(), False),
            T.StructField("n", T.LongType(), False),
        ]
    )

    def make():
        def work(columns):
            counts = Counter((label, s) for value, label in zip(*columns) if value for s in steps(value))
            return [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]

        return work

    counted = map_slices(samples, make, schema).groupBy("label", "step").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, SIZE * SIZE))
    for row in counted.collect():
        counts[row.label, row.step] = row.n
    return KeyModels.trained(counts)


def secret_spans(docs: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base and spans (arrays of kind, start, end; code points, end
    exclusive), base from the fixed patterns, spans with those of the models added; by start, then kind.

    A null text is empty and has none; a text of any length is read as a whole, in time that grows with its length. Rows are
    handled one by one: repeated rows get the same spans. Without
    any labelled string (an empty table) the models are even and add nothing. Only doc_id and text are
    looked at.
    """
    found = stored(scanned(docs), "scanned")
    models = train(labelled_samples(found, examples))
    schema = T.StructType([*found.schema.fields[:2], T.StructField("spans", T.ArrayType(_SPAN, False), False)])

    def make():
        def work(columns):
            out = [columns[0], columns[1], []]
            for base, strings in zip(columns[1], columns[2]):
                more = [
                    {"kind": KINDS[3], "start": s["start"], "end": s["start"] + len(s["value"])}
                    for s in strings
                    if s["label"] is None and models.is_random(s["value"])
                ]
                out[2].append(sorted(base + more, key=lambda x: (x["start"], KINDS.index(x["kind"]))))
            return out

        return work

    return map_slices(found, make, schema)


def span_digests(spans: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans as text (kind:start:end, joined by commas)."""

    def joined(column: str):
        texts = F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
        return F.array_join(texts, ",")

    def number(kind: str):
        own = F.filter("spans", lambda x: x["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id", *map(number, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    """The digest of ``span_digests`` for spans in plain Python."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
