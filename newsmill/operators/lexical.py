"""Full-text search: postings with positions, a small query language and BM25."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.operators.staging import staged

ACCENTS = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
#: Weights of title, summary, source name and author.
WEIGHTS = {"title": 10.0, "summary": 5.0, "source_name": 1.0, "author": 3.0}
K1, B = 1.2, 0.75


def plain(c: Column) -> Column:
    """Lower case without accents; a text of ASCII alone has none to look for."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, ACCENTS, PLAIN))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits without accents."""
    return F.filter(F.split(plain(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def parse(query: str) -> list[list[tuple[bool, list[str], bool]]]:
    """OR of ANDs of (negated, words of a phrase, last word is a prefix). A query
    that is no valid expression is taken as one phrase."""
    words = lambda s: re.findall(r"[^\W_]+", s.lower().translate(str.maketrans(ACCENTS, PLAIN)))
    if not re.fullmatch(r'\s*((NOT\s+)?("[^"]*"|\w+\*?)(\s+(AND|OR)\s+|\s+|$))+', query) or re.search(r"(AND|OR|NOT)\s*$", query):
        return [[(False, words(query), False)]] if words(query) else []
    out, group, negated = [], [], False
    for part in re.findall(r'"[^"]*"|\S+', query):
        if part == "OR":
            out, group = [*out, group], []
        elif part == "NOT":
            negated = True
        elif part != "AND" and words(part):
            group.append((negated, words(part), part.endswith("*")))
            negated = False
    return [g for g in [*out, group] if g]


def search(items: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """``id, score`` of the best matches. Scores are negative, best first, ties
    by id. Only the columns that are searched are read, and each is tokenized
    once; frequencies, lengths and numbers of rows are one aggregation of what
    was counted."""
    groups = parse(query)
    terms = list(dict.fromkeys((tuple(w), p) for g in groups for _, w, p in g))
    if not terms:
        return items.select("id", F.lit(0.0).alias("score")).limit(0)
    rows = items.select("id", *(tokens(F.col(c)).alias(c) for c in WEIGHTS))

    def hits(column: str, words: tuple, prefix: bool) -> Column:
        t = F.col(column)

        def fits(i):
            at = [F.get(t, i + k) == w for k, w in enumerate(words[:-1])]
            last = F.get(t, i + len(words) - 1)
            at.append(last.startswith(words[-1]) if prefix else last == words[-1])
            out = at[0]
            for x in at[1:]:
                out = out & x
            return F.coalesce(out, F.lit(False))

        if len(words) == 1 and not prefix:
            return F.size(F.filter(t, lambda x: x == words[0]))
        places = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(places, fits))

    # what is counted is narrow: written once, it serves the statistics and the scores
    counted = staged(rows.select("id", sum((F.size(c) for c in WEIGHTS), F.lit(0)).alias("d"), *(hits(c, w, p).alias(f"n{k}_{c}") for k, (w, p) in enumerate(terms) for c in WEIGHTS)))
    has = lambda k: sum((F.col(f"n{k}_{c}") for c in WEIGHTS), F.lit(0)) > 0
    stats = counted.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), *(F.count_if(has(k)).alias(f"df{k}") for k in range(len(terms))))
    scored = counted.crossJoin(F.broadcast(stats))
    number = {t: k for k, t in enumerate(terms)}
    match, score = F.lit(False), F.lit(0.0)
    for g in groups:
        own = F.lit(True)
        for negated, w, p in g:
            own = own & (~has(number[(tuple(w), p)]) if negated else has(number[(tuple(w), p)]))
        match = match | own
    for k, (w, p) in enumerate(terms):
        if all(neg for g in groups for neg, w2, p2 in g if (tuple(w2), p2) == (w, p)):
            continue
        f = sum((F.col(f"n{k}_{c}") * v for c, v in WEIGHTS.items()), F.lit(0.0))
        idf = F.greatest(F.ln((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)), F.lit(1e-6))
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.col("mean")))
    return scored.where(match).select("id", score.alias("score")).orderBy("score", "id").limit(limit)


def postings(items: DataFrame) -> DataFrame:
    """``term, id, n, weight``: an index of the searched columns; n occurrences in
    all, weight their weighted sum."""
    each = [items.select("id", F.explode(tokens(F.col(c))).alias("term"), F.lit(w).alias("w")) for c, w in WEIGHTS.items()]
    return functools.reduce(DataFrame.unionAll, each).groupBy("term", "id").agg(F.count("*").alias("n"), F.sum("w").alias("weight"))


def sync_postings(index: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after the items ``changed`` were written and the ids ``removed``
    deleted: only their postings are made anew."""
    old = changed.select("id").union(removed.select("id")).distinct()
    return index.join(old, "id", "left_anti").select("term", "id", "n", "weight").unionAll(postings(changed).select("term", "id", "n", "weight"))


def rebuilt(index: DataFrame, items: DataFrame) -> DataFrame:
    """The index, built where it is empty and the items aren't."""
    return postings(items) if index.isEmpty() and not items.isEmpty() else index
