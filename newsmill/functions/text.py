"""Column functions on titles, summaries, sources and URLs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmill.functions.scores import tenths, whole

# Title prefixes, breaking words, entity texts, white space.
PREFIXES = ("breaking:", "update:", "updated:", "exclusive:", "just in:", "developing:", "watch:", "live:", "opinion:", "analysis:", "review:")
PREFIXES_ALL = ("breaking:", "update:", "updated:", "exclusive:", "just in:", "developing:", "watch:", "video:", "live:")
BREAKING_WORDS = ("breaking", "just in", "urgent", "alert", "developing")
ENTITIES = (
    ("&#39;", "'"), ("&#34;", '"'), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
    ("&#x27;", "'"), ("&#x22;", '"'), ("&mdash;", "-"), ("&ndash;", "-"), ("&hellip;", "..."), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&lsquo;", "'"), ("&rsquo;", "'"),
)
WHITE = r"[\t\n\f\r ]+"


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_title(c: Column) -> Column:
    low = F.lower(F.trim(blank(c)))
    return F.trim(F.regexp_replace(low, "^(" + "|".join(PREFIXES) + ")", ""))


def normalize_title_all(c: Column) -> Column:
    out = F.trim(F.lower(blank(c)))
    for p in PREFIXES_ALL:
        out = F.trim(F.regexp_replace(out, "^" + p, ""))
    return F.trim(F.regexp_replace(out, WHITE, " "))


def sanitize_text(c: Column, limit: int) -> Column:
    """Tags and white space to single spaces, then at most ``limit`` characters."""
    if limit <= 0:
        return F.lit("")
    plain = F.regexp_replace(F.regexp_replace(blank(c), "<[^>]*>", " "), WHITE, " ")
    return F.substring(F.trim(plain), 1, limit)


def clean_summary(c: Column) -> Column:
    """Tags go, entities are decoded one after the other (so &amp;lt; becomes <),
    white space is folded and a leading "Comments" goes."""
    out = F.regexp_replace(blank(c), "<[^>]*>", "")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    out = F.trim(F.regexp_replace(out, WHITE, " "))
    return F.trim(F.regexp_replace(out, "^Comments", ""))


def truncate(c: Column, n: int) -> Column:
    """At most n characters; where something goes, the last three are dots."""
    if n < 1:
        return F.lit("")
    cut = F.substring(c, 1, n) if n <= 3 else F.concat(F.substring(c, 1, n - 3), F.lit("..."))
    return F.when(F.length(c) > n, cut).otherwise(c)


def extract_domain(c: Column) -> Column:
    out = F.regexp_replace(blank(c), "^.*?://", "")
    return F.regexp_replace(F.regexp_replace(out, "/.*$", ""), r"^www\.", "")


def source_abbrev(c: Column) -> Column:
    space = F.instr(c, " ")
    short = F.when((space > 1) & (space <= 10), F.substring_index(c, " ", 1)).otherwise(F.concat(F.substring(c, 1, 10), F.lit("..")))
    return F.when(F.octet_length(c) > 12, short).otherwise(c)


def derive_category(name: Column, kind: Column) -> Column:
    low = F.lower(name)
    has = lambda *words: F.greatest(*[low.contains(w) for w in words]) if len(words) > 1 else low.contains(words[0])
    return (
        F.when(low.startswith("r/"), "reddit").when(has("arxiv"), "arxiv").when(has("sec ", "edgar"), "sec").when(has("polymarket", "manifold"), "predictions").when(has("usgs"), "events")
        .when(has("google news", "techmeme", "memeorandum"), "aggregator").when(has("daily dot", "buzzfeed", "know your meme", "mashable", "input mag"), "viral").when(kind == "hn", "tech").otherwise(kind)
    )


def extract_probability(c: Column) -> Column:
    """The first integer of 0 to 100 right before a percent sign, else -1."""
    found = F.regexp_extract_all(blank(c), F.lit(r"([0-9]+)%"), 1)
    small = F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x <= 100)
    return F.coalesce(F.try_element_at(small, F.lit(1)), F.lit(-1)).cast("int")


def parse_first_price(c: Column) -> Column:
    first = F.regexp_extract(blank(c), r'^\s*\[\s*"?(-?[0-9]+(?:\.[0-9]+)?)"?', 1)
    return F.coalesce(F.nullif(first, F.lit("")).try_cast("double"), F.lit(0.5))


def is_breaking(title: Column, category: Column, age_minutes: Column) -> Column:
    words = F.lower(blank(title)).rlike("|".join(BREAKING_WORDS))
    return (age_minutes <= 30) & ((category == "wire") | words)


def contains_word(c: Column, word: str) -> Column:
    return blank(c).rlike(f"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])")


def slug_id(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def item_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def embed_text(title: Column, summary: Column, limit: int = 2000) -> Column:
    """The title, a space and what of the sanitised summary fits."""
    t = blank(title)
    rest = F.substring(F.trim(F.regexp_replace(F.regexp_replace(blank(summary), "<[^>]*>", " "), WHITE, " ")), F.lit(1), F.greatest(F.lit(limit) - F.length(t) - 1, F.lit(0)))
    return F.when(rest == "", t).otherwise(F.concat(t, F.lit(" "), rest))


def document_text(title: Column, summary: Column) -> Column:
    return F.when(blank(summary) == "", blank(title)).otherwise(F.concat(blank(title), F.lit(" - "), summary))


#: A number at the start of a word.
NUMBER = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def parse_score(c: Column) -> Column:
    """A relevance from model text: what a first word yes/no/maybe says, else the
    first word that starts with a number, clamped to 0..1, else 0.5; what is up to
    the first end of a think block is left out."""
    text = blank(c)
    text = F.regexp_replace(text, r"(?s)^.*?</think>", "")
    text = F.regexp_replace(text, r"^\s+", "")
    first = F.regexp_replace(F.lower(F.regexp_extract(text, r"^(\S*)", 1)), r"[.,!?]+$", "")
    number = F.nullif(F.regexp_extract(text, r"(?:^|\s)" + NUMBER, 1), F.lit("")).try_cast("double")
    return (
        F.when(first.isin("yes", "y", "true"), 1.0).when(first.isin("no", "n", "false"), 0.0).when(first.isin("maybe", "unclear", "uncertain"), 0.5)
        .otherwise(F.when(number.isNull(), 0.5).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))))
    )


def parse_score_tenths(c: Column) -> Column:
    """A score of 0 to 10 (or 0 to 1) from model text, as 0..1: the first word that
    is a number, without "/10" or a stop or comma; none: 0."""
    words = F.transform(F.split(F.trim(blank(c)), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "/10$", ""), r"\.$", ""), ",$", ""))
    numbers = F.filter(words, lambda w: w.rlike("^" + NUMBER + "$"))
    value = F.coalesce(F.try_element_at(numbers, F.lit(1)).try_cast("double"), F.lit(0.0))
    return F.greatest(F.least(F.when(value > 1, value / 10).otherwise(value), F.lit(1.0)), F.lit(0.0))


def truncate_bytes(c: Column, n: int, mark: str = "...", room: bool = True) -> Column:
    """At most n bytes, the mark inside them or (no room) after; a code point that
    would be cut goes whole."""
    raw = F.encode(blank(c), "UTF-8")
    keep = n - len(mark) if room else n
    # a byte of 0b10...... continues a code point: step back over at most three
    last = lambda k: F.conv(F.hex(F.substring(raw, k + 1, 1)), 16, 10).cast("int").between(128, 191)
    cut = F.when(~last(keep), keep).when(~last(keep - 1), keep - 1).when(~last(keep - 2), keep - 2).otherwise(keep - 3)
    return F.when(F.length(raw) <= n, blank(c)).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"), F.lit(mark)))


def trim_line(c: Column) -> Column:
    return F.regexp_replace(blank(c), "[\r\n]+$", "")


# Names of countries that aren't their key with a capital.
COUNTRY_NAMES = {
    "united_states": "United States", "united_kingdom": "United Kingdom", "north_korea": "North Korea", "south_korea": "South Korea",
    "south_africa": "South Africa", "saudi_arabia": "Saudi Arabia", "hong_kong": "Hong Kong", "european_union": "European Union",
}


def country_display(key: Column) -> Column:
    out = F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 2**31 - 1))
    for k, v in COUNTRY_NAMES.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def entity_display(name: Column) -> Column:
    """Words with a capital, underscores as spaces."""
    words = F.split(F.trim(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))), " ")


def context_snippet(text: Column, target: Column, around: int = 50) -> Column:
    """The first place of target in text, in any case, with so many characters on
    both sides, trimmed; empty where it isn't there."""
    at = F.position(F.lower(target), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.trim(F.substring(text, start, at + F.length(target) + around - start))).otherwise("")


def format_event(ts: Column, level: Column, comp: Column, kind: Column, msg: Column, dur_ms: Column, count: Column, source: Column, query: Column, err: Column) -> Column:
    """One line for an event: fixed widths, then what it has."""
    level = F.upper(blank(level))
    width = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " "))
    digits = F.when(dur_ms >= 100, whole(dur_ms)).when(dur_ms >= 1, tenths(dur_ms)).otherwise(F.format_string("%.2f", dur_ms))
    some = lambda c, name: F.when(blank(c) != "", F.concat(F.lit(name), c))
    head = F.concat(F.date_format(ts, "HH:mm:ss.SSS"), F.lit(" "), width(F.when(level == "", "?").otherwise(level), 5), F.lit(" ["), width(blank(comp), 6), F.lit("] "), width(blank(kind), 22))
    return F.concat_ws(" ", head, some(msg, "\u2014 "), F.when(dur_ms > 0, F.concat(F.lit("("), digits, F.lit("ms)"))), F.when(count > 0, F.concat(F.lit("n="), count.cast("string"))), some(source, "src="), F.when(blank(query) != "", F.concat(F.lit('q="'), query, F.lit('"'))), some(err, "err="))


def encode_vector(c: Column) -> Column:
    """A float vector as little-endian bytes."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(c)


def decode_vector(c: Column) -> Column:
    """Little-endian bytes as a float vector; bytes of an unfinished number go."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))

    return run(c)


def simhash(c: Column) -> Column:
    """64-bit map of word trigrams: one bit for each, by its hash modulo 64. A
    vectorized Python function: folding characters with SQL's higher-order
    functions took thirty times as long on whole documents."""
    def one(text: str) -> int:
        words = re.sub("[^a-z0-9 ]", "", (text or "").lower()).split()
        out = 0
        for i in range(len(words) - 2):
            h = 5381 & 63
            for b in " ".join(words[i : i + 3]).encode():
                h = (h * 33 + b) & 63
            out |= 1 << h
        return out - (1 << 64) if out >> 63 else out

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one).astype("int64")

    return run(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fnv32a(c: Column) -> Column:
    """FNV-1a of an ASCII text, as a non-negative long."""
    step = lambda h, x: ((h.bitwiseXOR(F.ascii(x).cast("bigint"))) * 16777619).bitwiseAND(4294967295)
    return F.aggregate(F.filter(F.split(blank(c), ""), lambda x: x != ""), F.lit(2166136261).cast("bigint"), step)
