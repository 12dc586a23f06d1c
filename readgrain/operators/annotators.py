"""Annotators: whatever turns texts into metrics by other means than column expressions.

An annotator has a name, the metrics it gives, and predict_batch(texts) -> list of dicts. Registered ones run inside a pandas UDF that makes
them once per Python worker. External models (encoders, judges, taggers) plug in here; what follows them is plain DataFrame code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, tuple[str, ...]]] = {}


def register(name: str, make: Callable, metrics: Sequence[str]) -> None:
    REGISTRY[name] = (make, tuple(metrics))


def annotate(rows: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """rows with a column `metrics`: a map from `annotator/metric` to a number; null texts have none."""
    maps = [_udf(n)(F.col(text)) for n in names]
    return rows.withColumn("metrics", F.map_concat(*maps) if len(maps) > 1 else maps[0])


def _udf(name: str) -> Callable[[Column], Column]:
    make, metrics = REGISTRY[name]

    @F.pandas_udf("map<string,double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            out = model.predict_batch([t or "" for t in batch])
            yield pd.Series([{} if t is None else {f"{name}/{m}": float(d[m]) for m in metrics} for t, d in zip(batch, out, strict=True)])

    return run


#: Causal connectives, each with what must stand before and after it.
CAUSAL = (
    r"(.+?) (?P<keyword>lead to|leads to|led to|leading to) (.+)",
    r"(.+?) (?P<keyword>give rise to|gave rise to|given rise to|giving rise to) (.+)",
    r"(.+?) (?P<keyword>induces|induced|inducing|induce) (.+)",
    r"(.+?) (?P<keyword>caused by|caused|causes|causing|cause) (.+)",
    r"(.+?) (?P<keyword>bring on|brought on|bringing on|brings on) (.+)",
    r"(.+?) (?P<keyword>result from|resulting from|results from|resulted from) (.+)",
    r"(?P<keyword>the reason for) (.+?) (?:is|are|was|were) (.+)",
    r"(?P<keyword>the reasons for) (.+?) (?:is|are|was|were) (.+)",
    r"(?P<keyword>the reason of) (.+?) (?:is|are|was|were) (.+)",
    r"(?P<keyword>the reasons of) (.+?) (?:is|are|was|were) (.+)",
    r"(?:a|an|the|one) effect of (.+?) (?:is|are|was|were) (?P<keyword>.+)",
    r"(.+?) (?:is|are|was|were) (?P<keyword>a reason for|an reason for|the reason for|one reason for) (.+)",
    r"(.+?) (?:is|are|was|were) (?P<keyword>a reasons for|an reasons for|the reasons for|one reasons for) (.+)",
    r"(.+?) (?:is|are|was|were) (?P<keyword>a reason of|an reason of|the reason of|one reason of) (.+)",
    r"(.+?) (?:is|are|was|were) (?P<keyword>a reasons of|an reasons of|the reasons of|one reasons of) (.+)",
    r"if (.+?), (?P<keyword>then) (.+)",
    r"if (.+?), (?P<keyword>,) (.+)",
    r"(.+?) (?P<keyword>because of) (.+)",
    r"(?P<keyword>because) (.+?), (.+)",
    r"(.+?), (?P<keyword>because) (.+)",
    r"(.+?) (?P<keyword>because) (.+)",
    r"(.+?),? (?P<keyword>thus|therefore|hence|consequently) (.+)",
    r"(.+?), (?P<keyword>as a consequence) (.+)",
    r"(?P<keyword>inasmuch as) (.+?), (.+)",
    r"(.+?), (?P<keyword>inasmuch as) (.+)",
    r"(?P<keyword>in consequence of) (.+?), (.+)",
    r"(.+?) (?P<keyword>in consequence of) (.+)",
    r"(?P<keyword>due to) (.+?), (.+)",
    r"(.+?) (?P<keyword>due to) (.+)",
    r"(?P<keyword>owing to) (.+?), (.+)",
    r"(.+?) (?P<keyword>owing to) (.+)",
    r"(.+?) (?P<keyword>as a result of) (.+)",
    r"(.+?) (?P<keyword>and hence) (.+)",
    r"(?P<keyword>as a consequence of) (.+?), (.+)",
    r"(.+?) (?P<keyword>as a consequence of) (.+)",
    r"(.+?) (?P<keyword>and consequently) (.+)",
    r"(.+?), (?P<keyword>for this reason alone) (.+)",
)


def _by_line(pattern: str) -> tuple[re.Pattern, tuple[str, ...]]:
    """A pattern of CAUSAL that reads each line once, and texts of which one must be there.

    Every pattern takes the rest of its line, so a line has one match at most: the first place with something before it, or the first beginning
    if what must follow it comes later in the line. If it doesn't, no later beginning matches, and the line is passed over (whole is None).
    """
    head, tail = pattern.split("(.+?)")
    keys = re.search(r"\(\?P<keyword>(.*?)\)", pattern)[1]
    before = ", " if "), (?P<keyword>" in pattern else " " if " (?P<keyword>" in pattern else ""
    needed = tuple(f"{before}{k} " for k in keys.split("|")) if keys != ".+" else (" effect of ",)
    return re.compile(f"{head}(?:.+?{tail}(?P<whole>)|.*)" if head else f"(?<=.){tail}(?P<whole>)"), needed


class CausalCounter:
    """Causal connectives of a text; a character counts for one connective only, earlier patterns first."""

    def __init__(self) -> None:
        self.patterns = [_by_line(p) for p in CAUSAL]

    def count(self, text: str) -> int:
        low = text.lower()
        found = bytearray(len(low))
        n = 0
        for p, needed in self.patterns:
            if not any(k in low for k in needed):
                continue
            for m in p.finditer(low):
                if m["whole"] is None:
                    continue
                a, b = m.span("keyword")
                if not any(found[a:b]):
                    found[a:b] = b"\x01" * (b - a)
                    n += 1
        return n

    def predict_batch(self, texts: Sequence[str]) -> list[dict]:
        return [{"count": self.count(t)} for t in texts]


register("causal", CausalCounter, ["count"])
