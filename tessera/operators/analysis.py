"""What a query names and asks for: known names in texts, the entity it is about, its dimensions, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as x
from tessera.scratch import materialize

#: Patterns are looked up by so many first characters, or all that they have.
KEY = 4
#: An entity is inferred where it leads the next one by this factor.
LEAD = 1.5
ENTITY_WEIGHT, EXACT_WEIGHT = 4, 3
#: Most entities, terms and dimensions of a query.
SPOTS, TERMS, DIMS = 3, 8, 3


def mentions(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern): the distinct *patterns* (pattern) that each of *texts* (id, text) holds, at any place.

    Each place of a text is joined to the patterns by its next KEY characters, and what follows is compared: an equi-join with a row for
    each place, however many patterns there are. The planner sends the patterns to all tasks where they are small.
    """
    length = F.length("pattern")
    known = materialize(patterns.filter(length > 0).select("pattern").distinct().select("pattern", F.substring("pattern", 1, KEY).alias("key")), "patterns")
    sizes = known.agg(F.collect_set(F.length("key")).alias("keys"), F.max(length).alias("most")).first()  # up to KEY numbers
    if not sizes.keys:
        return texts.select("id", F.lit(None).cast("string").alias("pattern")).limit(0)
    chars = texts.select("id", F.split("text", "").alias("c")).filter(F.size("c") > 0)
    ahead = lambda i: F.array_join(F.slice("c", i, sizes.most), "")
    places = chars.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("c")), ahead)).alias("ahead"))
    keyed = places.select("id", "ahead", F.explode(F.array(*map(F.lit, sorted(sizes.keys)))).alias("n")).filter(F.length("ahead") >= F.col("n"))
    found = keyed.withColumn("key", F.col("ahead").substr(F.lit(1), F.col("n"))).join(known, "key")
    return found.filter(F.startswith("ahead", "pattern")).select("id", "pattern").distinct()


def known_names(texts: DataFrame, unknown: DataFrame) -> DataFrame:
    """(id, in_range, uncovered): whether a text names none of the *unknown* (name), and those it names, the longest first."""
    found = mentions(texts, unknown.select(F.col("name").alias("pattern")))
    order = F.expr("transform(array_sort(collect_list(struct(-length(pattern) AS n, pattern AS name))), s -> s.name)")
    named = found.groupBy("id").agg(order.alias("uncovered"))
    out = texts.select("id").join(named, "id", "left").withColumn("uncovered", F.coalesce("uncovered", F.array().cast("array<string>")))
    return out.select("id", (F.size("uncovered") == 0).alias("in_range"), "uncovered")


def cjk_terms(text: Column) -> Column:
    """Stretches of 2 to 4 characters of each run of CJK characters."""
    runs = F.regexp_extract_all(text, F.lit("[\\x{4E00}-\\x{9FFF}]{2,}"), F.lit(0))

    def stretches(run: Column) -> Column:
        ends = lambda n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substr(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.concat(ends(2), ends(3), ends(4))

    return F.array_distinct(F.flatten(F.transform(runs, stretches)))


def entity_index(texts: DataFrame, terms=cjk_terms, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(term, spot): the terms that only one entity's *texts* (spot, text) hold."""
    each = texts.filter("spot IS NOT NULL").select("spot", F.explode(terms(F.col("text"))).alias("term")).filter(~F.col("term").isin(*stopwords) if stopwords else F.lit(True))
    by = each.groupBy("term").agg(F.min("spot").alias("spot"), F.max("spot").alias("last"))
    return by.filter("spot = last").select("term", "spot")


def analyze(queries: DataFrame, names: DataFrame, entities: DataFrame, tags: DataFrame, aliases: DataFrame, cues: DataFrame, terms=cjk_terms, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(id, spot_names, spot_confidence, entity_terms, active_dimensions, dimension_values, dimension_sources, confidence) of *queries* (id, text).

    *names* (spot, alias) name entities outright; *entities* is entity_index(); *tags* (dim, tag) and their *aliases* (tag, alias) are values
    asked for; *cues* (dim, cue) hint at a dimension, one without cues at its own name. Names, tags and cues are found in the
    text without case, white space and punctuation; what ties goes by name.
    """
    norm = x.normalize_match
    texts = materialize(queries.select("id", F.coalesce("text", F.lit("")).alias("text")), "queries")
    spot = names.select("spot", norm(F.col("alias")).alias("pattern")).filter("pattern <> ''").distinct()
    tag = tags.select("dim", "tag", norm(F.col("tag")).alias("pattern")).filter(F.length("pattern") >= 2).distinct()
    alias = tag.select("dim", "tag").join(aliases, "tag").select("dim", "tag", norm(F.col("alias")).alias("pattern")).filter("pattern <> ''").distinct()
    bare = tags.select("dim").distinct().join(cues, "dim", "left_anti").select("dim", F.col("dim").alias("cue"))
    cue = cues.join(tags.select("dim").distinct(), "dim", "left_semi").select("dim", "cue").unionByName(bare).select("dim", "cue", norm(F.col("cue")).alias("pattern"))
    every = spot.select("pattern").unionByName(tag.select("pattern")).unionByName(alias.select("pattern")).unionByName(cue.select("pattern"))
    held = materialize(mentions(texts.select("id", norm(F.col("text")).alias("text")), every), "mentions")

    named = held.join(spot, "pattern").groupBy("id", "spot").agg((F.max(F.length("pattern")) / 100.0 + 1.0).alias("score"))
    named = materialize(named, "named")
    mine = texts.select("id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(entities, "term")
    outright = named.select("id", F.lit(True).alias("outright")).distinct()
    fits = mine.join(outright, "id", "left").join(named.select("id", "spot", F.lit(True).alias("own")), ["id", "spot"], "left")
    kept = materialize(fits.filter("outright IS NULL OR own").select("id", "spot", "term", "outright"), "terms")
    counts = kept.filter("outright IS NULL").groupBy("id", "spot").agg(F.sum(F.least(F.length("term"), F.lit(ENTITY_WEIGHT))).alias("n"))
    best = Window.partitionBy("id").orderBy(F.desc("n"), "spot")
    led = counts.withColumns({"place": F.row_number().over(best), "next": F.lead("n").over(best)}).filter(f"place = 1 AND (next IS NULL OR n >= next * {LEAD})")
    scores = named.unionByName(led.select("id", "spot", F.least(F.lit(0.88), F.lit(0.45) + F.col("n") / 20.0).alias("score")))

    first = lambda n, keys, value: f"transform(slice(array_sort(collect_list(struct({keys}, {value} AS v))), 1, {n}), s -> s.v)"
    spots = scores.groupBy("id").agg(F.expr(first(SPOTS, "-score AS k, spot AS t", "spot")).alias("spot_names"), F.least(F.lit(1.0), F.max("score")).alias("spot_confidence"))
    words = kept.select("id", "term").distinct().groupBy("id").agg(F.expr(first(TERMS, "-length(term) AS k, term AS t", "term")).alias("entity_terms"))

    exact = held.join(tag, "pattern").select("id", "dim", "tag", F.lit("exact").alias("source"))
    other = held.join(alias, "pattern").select("id", "dim", "tag").distinct().join(exact, ["id", "dim", "tag"], "left_anti").select("id", "dim", "tag", F.lit("alias").alias("source"))
    asked = exact.unionByName(other).groupBy("id", "dim").agg(F.count("*").alias("exact"), F.sort_array(F.collect_set("tag")).alias("tags"), F.sort_array(F.collect_set("source")).alias("sources"))
    hinted = held.join(cue, "pattern").groupBy("id", "dim").agg(F.count("*").alias("cues"))
    dims = asked.join(hinted, ["id", "dim"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("exact", "cues")})
    dims = dims.filter(~F.col("dim").isin(*excluded)) if excluded else dims
    order = Window.partitionBy("id").orderBy(F.desc(F.col("cues") + EXACT_WEIGHT * F.col("exact")), F.desc("exact"), "dim")
    top = dims.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= DIMS)
    pick = lambda c: F.expr(f"map_from_entries(filter(transform(array_sort(collect_list(struct(place, dim, {c} AS v))), s -> struct(s.dim, s.v)), s -> s.v IS NOT NULL))")
    active = top.groupBy("id").agg(
        F.expr("transform(array_sort(collect_list(struct(place, dim))), s -> s.dim)").alias("active_dimensions"), pick("tags").alias("dimension_values"), pick("sources").alias("dimension_sources"),
        F.count_if(F.col("cues") > 0).alias("cue_total"), F.sum("exact").alias("exact_total"),
    )
    strings, lists = "array<string>", "map<string,array<string>>"
    out = texts.select("id").join(spots, "id", "left").join(words, "id", "left").join(active, "id", "left")
    part = lambda c: 0.15 * F.least(F.coalesce(c, F.lit(0)), F.lit(3))
    sure = F.coalesce("spot_confidence", F.lit(0.0))
    total = F.least(F.lit(1.0), 0.45 * sure + part("cue_total") + part("exact_total"))
    return out.select(
        "id", *[F.coalesce(c, F.array().cast(strings)).alias(c) for c in ("spot_names",)], F.round(sure, 4).alias("spot_confidence"),
        *[F.coalesce(c, F.array().cast(strings)).alias(c) for c in ("entity_terms", "active_dimensions")],
        *[F.coalesce(c, F.create_map().cast(lists)).alias(c) for c in ("dimension_values", "dimension_sources")], F.round(total, 4).alias("confidence"),
    )
