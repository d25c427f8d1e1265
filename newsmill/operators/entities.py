"""Tickers, countries, attributions, claims and conflicts in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.functions.text import contains_word

# The aliases of each country or bloc.
COUNTRIES = {
    "united_states": ("united states", "usa", "us", "u.s.", "u.s", "america", "american"),
    "china": ("china", "chinese", "prc", "beijing"),
    "russia": ("russia", "russian", "moscow", "kremlin"),
    "united_kingdom": ("united kingdom", "uk", "britain", "british", "england"),
    "germany": ("germany", "german", "berlin"),
    "france": ("france", "french", "paris"),
    "japan": ("japan", "japanese", "tokyo"),
    "india": ("india", "indian", "new delhi"),
    "ukraine": ("ukraine", "ukrainian", "kyiv", "kiev"),
    "israel": ("israel", "israeli", "tel aviv", "jerusalem"),
    "palestine": ("palestine", "palestinian", "gaza", "west bank"),
    "iran": ("iran", "iranian", "tehran"),
    "north_korea": ("north korea", "dprk", "pyongyang"),
    "south_korea": ("south korea", "korea", "seoul"),
    "taiwan": ("taiwan", "taiwanese", "taipei"),
    "syria": ("syria", "syrian", "damascus"),
    "afghanistan": ("afghanistan", "afghan", "kabul"),
    "iraq": ("iraq", "iraqi", "baghdad"),
    "canada": ("canada", "canadian", "ottawa"),
    "australia": ("australia", "australian", "sydney", "canberra"),
    "brazil": ("brazil", "brazilian", "brasilia"),
    "mexico": ("mexico", "mexican", "mexico city"),
    "italy": ("italy", "italian", "rome"),
    "spain": ("spain", "spanish", "madrid"),
    "netherlands": ("netherlands", "dutch", "amsterdam"),
    "switzerland": ("switzerland", "swiss", "zurich"),
    "sweden": ("sweden", "swedish", "stockholm"),
    "norway": ("norway", "norwegian", "oslo"),
    "poland": ("poland", "polish", "warsaw"),
    "turkey": ("turkey", "turkish", "ankara"),
    "saudi_arabia": ("saudi arabia", "saudi", "riyadh"),
    "uae": ("uae", "emirates", "dubai", "abu dhabi"),
    "egypt": ("egypt", "egyptian", "cairo"),
    "south_africa": ("south africa",),
    "nigeria": ("nigeria", "nigerian"),
    "indonesia": ("indonesia", "indonesian", "jakarta"),
    "singapore": ("singapore",),
    "hong_kong": ("hong kong",),
    "vietnam": ("vietnam", "vietnamese", "hanoi"),
    "thailand": ("thailand", "thai", "bangkok"),
    "philippines": ("philippines", "filipino", "manila"),
    "malaysia": ("malaysia", "malaysian", "kuala lumpur"),
    "argentina": ("argentina", "argentine", "buenos aires"),
    "chile": ("chile", "chilean", "santiago"),
    "colombia": ("colombia", "colombian", "bogota"),
    "venezuela": ("venezuela", "venezuelan", "caracas"),
    "european_union": ("european union", "eu", "brussels"),
    "nato": ("nato",),
    "asean": ("asean",),
    "opec": ("opec",),
}
# Who is cited, most telling pattern first.
ATTRIBUTIONS = (
    r"(?i)according to (Reuters|AP|AFP|Bloomberg|NYT|New York Times|Washington Post|WSJ|Wall Street Journal|CNN|BBC|Fox News|CNBC)",
    r"(?i)(Reuters|AP|AFP|Bloomberg) reports?",
    r"(?i)reported by (Reuters|AP|AFP|Bloomberg|NYT|Washington Post)",
    r"(?i)citing (Reuters|AP|AFP|Bloomberg|sources)",
    r"(?i)\((Reuters|AP|AFP|Bloomberg)\)",
)


def tickers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\$([A-Z]{1,5}(?:\.[A-Z])?)"), 1))


def _trie(words: list[str]) -> str:
    """A pattern of the words that tries longer ones first and shares their starts."""
    import re

    by: dict[str, list[str]] = {}
    for word in words:
        if word:
            by.setdefault(word[0], []).append(word[1:])
    if not by:
        return ""
    inner = "(?:" + "|".join(re.escape(k) + _trie(rest) for k, rest in sorted(by.items())) + ")"
    return inner + "?" if "" in words else inner


def countries(c: Column) -> Column:
    """Ids of the countries named as whole words, sorted. One pass finds the longest
    name at the start of each word; names that it starts with count as well."""
    import re

    names = sorted((word, key) for key, words in COUNTRIES.items() for word in words)
    meant = {word: sorted({key for short, key in names if word == short or (word.startswith(short) and not re.match("[a-z0-9]", word[len(short)]))}) for word, _ in names}
    known = F.create_map(*[x for word, keys in meant.items() for x in (F.lit(word), F.array(*map(F.lit, keys)))])
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.regexp_extract_all(low, F.lit(f"(?<![a-z0-9])(?=({_trie(list(meant))})(?![a-z0-9]))"), 1)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(found), lambda x: F.element_at(known, x)))))


def attribution(c: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit("")) for p in ATTRIBUTIONS])


def entities(items: DataFrame) -> DataFrame:
    """``pos, entity_id, kind, salience`` of each entity of title and summary."""
    text = F.concat_ws(" ", "title", "summary")
    shape = lambda kind, salience: lambda x: F.struct(F.concat(F.lit(f"{kind}:"), x).alias("entity_id"), F.lit(kind).alias("kind"), F.lit(salience).alias("salience"))
    cited = attribution(text)
    one = F.when(cited.isNotNull(), F.array(cited)).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(F.transform(tickers(text), shape("ticker", 0.9)), F.transform(countries(text), shape("country", 0.7)), F.transform(one, shape("source", 0.5)))
    return items.select("pos", F.explode(all_).alias("e")).select("pos", "e.*")


# Patterns of claims. A speaker starts where a run of words does, or
# where the last match ended: no later start fits if that doesn't.
CLAIMS = {
    "number": r"(\$?[\d,]+\.?\d*)\s*(billion|million|thousand|percent|%|people|deaths|cases|troops|dollars)",
    "quote": r'"([^"]{10,200})"',
    "attribution": r"(?id)(?:(?<![\w\s])|\G)([\w\s]+)\s+(said|says|claims?|denied|announced|confirmed|reported|stated)\s+(?:that\s+)?(.{10,100})",
    "prediction": r"(?id)(will|expected to|forecast|predicted|projected)\s+(.{10,100})",
}


def extract_claims(items: DataFrame) -> DataFrame:
    """``pos, kind, text, value, speaker, confidence``: numbers, quotes,
    attributions, denials (attributions by "denied") and predictions of title and
    summary. Repeated claims keep a row each."""
    # each text is searched once for a kind: the groups come from what was found, which splits in the same way alone
    text = F.concat_ws(" ", "title", "summary")
    items = items.select("pos", *(F.regexp_extract_all(text, F.lit(p), 0).alias(kind) for kind, p in CLAIMS.items()))
    found = lambda kind, value, speaker, confidence: lambda x: F.struct(F.lit(kind).alias("kind"), x["0"].alias("text"), value(x).alias("value"), speaker(x).alias("speaker"), F.lit(confidence).alias("confidence"))
    nobody = lambda x: F.lit("")
    zipped = lambda kind, n: F.transform(kind, lambda x: F.struct(x.alias("0"), *(F.regexp_extract(x, CLAIMS[kind], k).alias(str(k)) for k in range(1, n + 1))))
    said = zipped("attribution", 3)
    speaker = lambda x: F.regexp_replace(x["1"], r"^\s+|\s+$", "")
    claims = F.concat(
        F.transform(zipped("number", 2), found("number", lambda x: F.concat(x["1"], F.lit(" "), x["2"]), nobody, 0.8)),
        F.transform(zipped("quote", 1), found("quote", lambda x: x["1"], nobody, 0.9)),
        F.transform(said, found("attribution", lambda x: x["3"], speaker, 0.7)),
        F.transform(F.filter(said, lambda x: F.lower(x["2"]) == "denied"), found("denial", lambda x: x["3"], speaker, 0.8)),
        F.transform(zipped("prediction", 2), found("prediction", lambda x: x["2"], nobody, 0.6)),
    )
    return items.select("pos", F.explode(claims).alias("c")).select("pos", "c.*")


def overlaps(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """``pos, cluster, overlap``: how many entities (pos, entity_id) of an item
    items of a cluster (pos, cluster) have; clusters without one aren't listed. An
    entity meets each cluster once, whatever the number of items that have it."""
    own = entities.select("pos", "entity_id").distinct()
    index = own.join(clusters, "pos").select("entity_id", "cluster").distinct()
    return own.join(index, "entity_id").groupBy("pos", "cluster").agg(F.count("*").alias("overlap"))


def extract_number(c: Column) -> Column:
    plain = F.regexp_replace(c, r"[$,]", "")
    low = F.lower(plain)
    times = F.when(low.contains("billion"), 1e9).when(low.contains("million"), 1e6).when(low.contains("thousand"), 1e3).otherwise(1.0)
    return F.coalesce(F.nullif(F.regexp_extract(plain, r"^\s*(-?[0-9]*\.?[0-9]+)", 1), F.lit("")).try_cast("double"), F.lit(0.0)) * times


def numbers_conflict(a: Column, b: Column) -> Column:
    """More than 20 % of their mean apart; never with a number of 0."""
    return F.coalesce((a != 0) & (b != 0) & (F.try_divide(F.abs(a - b), (a + b) / 2) > 0.2), F.lit(False))


def conflict_kind() -> Column:
    """How the claims a and b contradict each other; null if they don't."""
    return (
        F.when((F.col("a.kind") == "number") & (F.col("b.kind") == "number") & numbers_conflict(extract_number(F.col("a.value")), extract_number(F.col("b.value"))), "factual")
        .when((F.col("a.kind") == "denial") | (F.col("b.kind") == "denial"), "denial")
        .when((F.col("a.kind") == "attribution") & (F.col("b.kind") == "attribution") & (F.col("a.speaker") == F.col("b.speaker")) & (F.col("a.value") != F.col("b.value")), "framing")
    )


def conflicts(claims: DataFrame) -> DataFrame:
    """Pairs of claims (group, side, kind, text, value, speaker) of two sides of
    a group that contradict each other."""
    a, b = claims.where("side = 1").alias("a"), claims.where("side = 2").alias("b")
    return a.join(b, F.col("a.group") == F.col("b.group")).select(F.col("a.group").alias("group"), conflict_kind().alias("kind"), F.col("a.text").alias("claim_a"), F.col("b.text").alias("claim_b")).where("kind IS NOT NULL")


def item_conflicts(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster, pos_a, pos_b, kind, claim_a, claim_b``: claims of two items of a
    cluster (pos, cluster) that contradict each other; the earlier item is a."""
    claims = extract_claims(items).join(clusters, "pos")
    a, b = claims.alias("a"), claims.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.pos") < F.col("b.pos")))
    return pairs.select("a.cluster", F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), conflict_kind().alias("kind"), F.col("a.text").alias("claim_a"), F.col("b.text").alias("claim_b")).where("kind IS NOT NULL")


__all__ = ["attribution", "conflicts", "contains_word", "countries", "entities", "extract_claims", "extract_number", "item_conflicts", "numbers_conflict", "overlaps", "tickers"]
