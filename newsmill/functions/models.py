"""Hooks for embedders and rerankers, and the offline ones used in tests."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[pd.Series], list[list[float]]]
Scorer = Callable[[str, pd.Series], list[float]]


def byte_sum_vector(c: Column) -> Column:
    """The offline embedder: three numbers from the sum of the bytes modulo 97."""
    hexed = F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))
    pairs = F.regexp_extract_all(hexed, F.lit("([0-9A-F]{2})"), 1)
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + F.conv(x, 16, 10).cast("bigint"))
    b = (total % 97) / 97.0
    return F.array(*[(b + d).cast("float") for d in (0.1, 0.2, 0.3)])


def embed(items: DataFrame, text: Column, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """Vectors from a Python embedder, a batch of texts at a time. A batch that
    fails is tried again text by text; what fails then has a null vector."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(embedder(texts))
        except Exception:  # noqa: BLE001
            one = []
            for t in texts:
                try:
                    one.append(embedder(pd.Series([t]))[0])
                except Exception:  # noqa: BLE001
                    one.append(None)
            return pd.Series(one)

    return items.withColumn(out, run(text))


def rerank(items: DataFrame, query: str, text: Column, scorer: Scorer, n: int = 30) -> DataFrame:
    """The first n items by ``pos`` in the order of a scorer, the others after
    them; n is a small number, so only that many texts are scored."""

    @F.pandas_udf("float")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, texts))

    head = items.orderBy("pos").limit(n)
    scored = head.select("id", run(text).alias("relevance"))
    return items.join(scored, "id", "left").orderBy(F.desc_nulls_last("relevance"), "pos")


# What a reranker is asked for, by name.
RUBRICS = {
    "frontpage": """Most important news stories with real-world impact, broad relevance, and credible sourcing.
Prefer clear facts over speculation, multi-source confirmation.
Avoid duplicates, clickbait, promotional content.""",
    "breaking": """Breaking news and urgent developments from the last few hours.
High potential impact, developing situations, wire service reports.
Factual claims, official statements, confirmed events.""",
    "topstories": """Most important breaking news and major world developments.
Significant events with broad impact. Major policy changes.
Breaking situations. High-impact technology or science news.""",
    "tech": """Significant technology news and developments.
AI/ML breakthroughs, major product launches, security incidents.
Infrastructure changes, developer tools, industry shifts.""",
    "finance": """Important financial and economic news.
Market-moving events, policy changes, earnings surprises.
Economic indicators, regulatory actions, major deals.""",
    "science": """Significant scientific discoveries and research.
Peer-reviewed findings, space exploration, climate science.
Medical breakthroughs, technology advances.""",
    "security": """Cybersecurity news and threats.
Data breaches, vulnerabilities, nation-state attacks.
Security research, defensive tools, incident response.""",
    "geopolitics": """International relations and geopolitical developments.
Diplomatic actions, conflicts, treaties, sanctions.
Elections, leadership changes, regional tensions.""",
}


def rubric(name: Column) -> Column:
    """The text of a rubric; unknown names: that of the top stories."""
    out = F.lit(RUBRICS["topstories"])
    for key, text in RUBRICS.items():
        out = F.when(name == key, text).otherwise(out)
    return out
