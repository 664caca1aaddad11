"""TF-IDF similarity join with threshold, gated by date, best match per probe.

Statistics are kept per ``circuit`` over all indexed texts.  A text's vector has unit length, its
terms ordered from rare to common.  Its *prefix* ends where the terms left over are too light to
reach the threshold alone, so two similar texts share a term of their prefixes: common terms make
no candidates.  Captions with two sides must be similar on both, so their lists are keyed by a
prefix term of each side.  Vectors travel with the list entries and every candidate is scored in
full; nothing is approximate.

Indexed texts that can have no candidate are left out before their vectors are made: the most
common terms of a circuit are known where a text is read, all others weigh at least as much as the
least of these, so what a text's common terms weigh at most is known there too.  It stays if a term
that may be in its prefix is in the prefix of a probe (of rare terms by hash, which keeps too many).

Equal captions are compared once; their dates come in afterwards.  Of indexed cases with equal
captions and dates the one with the lowest order stands for all.  A window of dates ends in one
block of years and begins in the block before, so running minima from both ends of the blocks give
the first case of each window without a row for each date in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PLAIN, normalize_caption, split_caption, to_time
from ..session import staged

TERM = r"(?U)\b\w\w+\b"
#: Scores are rounded to 12 digits, so a prefix must not be cut short by less than that.
_SLACK = 1e-9
#: Most terms of a circuit that are known wherever texts are read.
_COMMON = 64
#: Hash buckets of the rare terms in the probes' prefixes, and the mark of a text that stays without one.
_BUCKETS = 1 << 21
_STAYS = -1

Function = Callable[[Column], Column]


def word_terms(norm: Column) -> Column:
    """Words of two characters and more."""
    spaced = F.filter(F.split(norm, " "), lambda t: F.length(t) > 1)
    return F.when(F.translate(norm, PLAIN + "_", "") != "", F.regexp_extract_all(norm, F.lit(TERM), F.lit(0))).otherwise(spaced)


def texts(cases: DataFrame, sided: bool, normalize: Function = normalize_caption) -> DataFrame:
    """``cases`` with ``norms``: the normalised caption, or both of its sides where it has two."""
    if sided:
        return cases.where("parts.left is not null").withColumn("norms", F.array(normalize(F.col("parts.left")), normalize(F.col("parts.right"))))
    return cases.withColumn("norms", F.array(normalize(F.col("name"))))


def frequencies(norms: DataFrame, analyze: Function = word_terms) -> DataFrame:
    """``(circuit, term, df, total)`` over ``norms(circuit, norm, n)``, texts that occur ``n`` times."""
    total = norms.groupBy("circuit").agg(F.sum("n").alias("total"))  # one row per circuit
    each = norms.select("circuit", "n", F.explode_outer(F.array_distinct(analyze(F.col("norm")))).alias("term")).where("term is not null")  # outer: else the terms are made twice
    return each.groupBy("circuit", "term").agg(F.sum("n").alias("df")).join(F.broadcast(total), "circuit")


def weighed(counts: DataFrame, max_df: float = 0.8, min_df: int = 1) -> DataFrame:
    """``(circuit, term, df, idf)``, smoothed logarithmic weights.

    Terms in more than the share ``max_df`` of the texts or in fewer than ``min_df`` texts are left out.
    """
    return counts.where(_kept(max_df, min_df)).select("circuit", "term", "df", _idf(F.col("df")).alias("idf"))


def _kept(max_df: float, min_df: int) -> Column:
    return (F.col("df") <= F.lit(max_df) * F.col("total")) & (F.col("df") >= min_df)


def _idf(df: Column) -> Column:
    return F.log((1 + F.col("total")) / (1 + df)) + 1


def vocabulary(norms: DataFrame, max_df: float = 0.8, min_df: int = 1, analyze: Function = word_terms) -> DataFrame:
    """The terms of ``norms`` with their weights, see ``frequencies`` and ``weighed``."""
    return weighed(frequencies(norms, analyze), max_df, min_df)


def _common_terms(counts: DataFrame, prefixes: list[DataFrame], max_df: float, min_df: int) -> DataFrame:
    """Per circuit: ``common``, its most common terms with weight and whether a probe's prefix has them, and ``least``, the least weight of any other."""
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy("circuit").orderBy(F.desc("df")))).where(F.col("_r") <= _COMMON + 1)
    below = F.coalesce(F.max(F.when(F.col("_r") > _COMMON, F.col("df"))).over(Window.partitionBy("circuit")), F.lit(0))
    top = top.withColumn("below", below)
    for i, prefix in enumerate(prefixes):
        top = top.join(F.broadcast(prefix.join(F.broadcast(top.select("circuit", "term")), ["circuit", "term"], "semi").withColumn(f"in{i}", F.lit(True))), ["circuit", "term"], "left")
    entry = F.struct("df", F.when(_kept(max_df, min_df), _idf(F.col("df"))).otherwise(0.0).alias("idf"), *(F.coalesce(f"in{i}", F.lit(False)).alias(f"in{i}") for i in range(len(prefixes))))
    never_dropped = (F.col("below") <= F.lit(max_df) * F.col("total")) & F.lit(min_df <= 1)
    return top.groupBy("circuit").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("df") > F.col("below"), F.struct("term", entry)))).alias("common"), F.min(F.when(never_dropped, _idf(F.col("below"))).otherwise(0.0)).alias("least")
    )


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("circuit"), term), F.lit(_BUCKETS))


def _with_candidates(rows: DataFrame, counts: DataFrame, probes: DataFrame, sides: int, threshold: float, max_df: float, min_df: int, analyze: Function) -> DataFrame:
    """Those of ``rows(circuit, norms, ...)`` that may share a prefix term with a probe on each side; some come more than once.

    ``probes(circuit, side, term)``: the terms of the probes' prefixes.
    """
    prefixes = [probes.where(F.col("side") == i).select("circuit", "term").distinct() for i in range(sides)]
    share = (threshold - _SLACK) ** 2
    columns = rows.columns
    out = rows.join(F.broadcast(_common_terms(counts, prefixes, max_df, min_df)), "circuit")
    for i, prefix in enumerate(prefixes):
        out = out.withColumn("_all", analyze(F.get("norms", F.lit(i))))
        out = out.withColumn("_t", F.transform(F.array_distinct("_all"), lambda t: F.struct(t.alias("t"), F.try_element_at("common", t).alias("c"), F.size(F.filter("_all", lambda x: x == t)).alias("n"))))
        out = out.withColumn("_known", F.array_sort(F.transform(
            F.filter("_t", lambda x: x["c"]["idf"] > 0), lambda x: F.struct(x["c"]["df"].alias("df"), x["t"].alias("t"), F.pow(x["n"] * x["c"]["idf"], 2.0).alias("w"), x["c"][f"in{i}"].alias("hit"))  # noqa: B023
        )))
        out = out.withColumn("_rare", F.filter("_t", lambda x: x["c"].isNull()))
        rare = F.aggregate("_rare", F.lit(0.0), lambda acc, x: acc + x["n"] * x["n"]) * F.col("least") * F.col("least")
        out = out.withColumn("_length", F.aggregate("_known", F.lit(0.0), lambda acc, x: acc + x["w"]) + rare)
        tail = lambda k: F.aggregate(F.slice("_known", k + 1, F.size("_known")), F.lit(0.0), lambda acc, x: acc + x["w"])
        near = F.size(F.filter("_known", lambda x, k: x["hit"] & (tail(k) >= F.lit(share) * F.col("_length")))) > 0  # noqa: B023
        out = out.withColumn("_keys", F.when(near, F.array(F.lit(_STAYS).cast("long"))).otherwise(F.transform("_rare", lambda x: _bucket(x["t"]))))
        out = out.select(*columns, "common", "least", F.explode_outer("_keys").alias("_key"))  # outer: else its filter is pushed into all of the above
        buckets = prefix.select(_bucket(F.col("term")).alias("_key")).distinct().withColumn("_in", F.lit(True))  # bounded
        out = out.join(F.broadcast(buckets), "_key", "left").where((F.col("_key") == _STAYS) | F.col("_in")).drop("_key", "_in")
    return out.select(*columns)


def vectors(norms: DataFrame, vocab: DataFrame, threshold: float, analyze: Function = word_terms) -> DataFrame:
    """``(circuit, norm, terms, prefix)``: the unit vector of each text from rare to common terms, and its prefix.

    Texts without a term of the vocabulary are similar to nothing and are left out.
    """
    tf = norms.select("circuit", "norm").distinct().select("circuit", "norm", F.explode(analyze(F.col("norm"))).alias("term")).groupBy("circuit", "norm", "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(vocab, ["circuit", "term"]).select("circuit", "norm", F.struct("df", "term", (F.col("tf") * F.col("idf")).alias("w")).alias("t"))
    lists = raw.groupBy("circuit", "norm").agg(F.sort_array(F.collect_list("t")).alias("t"), F.sqrt(F.sum(F.col("t.w") * F.col("t.w"))).alias("length"))
    unit = lists.select("circuit", "norm", F.transform("t", lambda x: F.struct(x["term"].alias("term"), (x["w"] / F.col("length")).alias("w"))).alias("terms"))
    least = (threshold - _SLACK) ** 2
    from_here = lambda i: F.aggregate(F.slice("terms", i + 1, F.size("terms")), F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"])
    return unit.withColumn("prefix", F.transform(F.filter("terms", lambda x, i: from_here(i) >= least), lambda x: x["term"]))


def _with_vectors(rows: DataFrame, vecs: DataFrame, sides: int) -> DataFrame:
    """``rows`` with the vector ``v0`` (and ``v1``) of each side and a row per list key."""
    out = rows
    for i in range(sides):
        mine = vecs.select("circuit", F.col("norm").alias("_norm"), F.col("terms").alias(f"v{i}"), F.col("prefix").alias(f"p{i}"))
        out = out.withColumn("_norm", F.get("norms", F.lit(i))).join(mine, ["circuit", "_norm"]).drop("_norm")
    for i in range(sides):
        out = out.withColumn(f"k{i}", F.explode(f"p{i}")).drop(f"p{i}")
    return out


def _dot(a: str, b: str) -> Column:
    weights = F.map_from_entries(b)
    return F.round(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x["w"] * F.coalesce(F.element_at(weights, x["term"]), F.lit(0.0))), 12)


def link_cases(
    cases: DataFrame, side_threshold: float = 0.7, cutoff: float = 0.65, bonus: float = 0.15, max_df: float = 0.8, min_df: int = 1, years: int = 7,
    normalize: Function = normalize_caption, analyze: Function = word_terms,
) -> DataFrame:
    """Best originating case of each appellate case: ``(circuit, a, d, score)``.

    ``cases(circuit, doc, ord, name, decision_date, is_appellate)``.  Captions with a connector
    compare both sides, each of which must reach ``side_threshold``; the others compare whole
    captions and get ``bonus``.  Scores must exceed ``cutoff``.  A trial case lies in the ``years``
    before the appeal; a null or unreadable date of the appeal accepts all.  Ties go to the lowest ``ord``, then
    to the smallest ``doc``.  ``normalize`` makes the text of a caption and ``analyze`` its terms.
    """
    named = cases.where("is_appellate in (0, 1)").select("circuit", "doc", "ord", "is_appellate", to_time(F.col("decision_date")).alias("decision_date"), "name", split_caption(F.col("name")).alias("parts"))
    named = named.withColumns({"left": F.col("parts.left"), "right": F.col("parts.right")})
    compared = F.when((F.col("is_appellate") == 0) | F.col("left").isNull(), F.array(normalize(F.col("name"))))
    both = F.when(F.col("left").isNotNull(), F.array(normalize(F.col("left")), normalize(F.col("right"))))
    captions = staged(named.select("circuit", "doc", "ord", "is_appellate", "decision_date", compared.alias("whole"), both.alias("sides")), "captions")
    out = None
    for sided in (False, True):
        sides, threshold = (2, side_threshold) if sided else (1, cutoff)
        mine = captions.select("circuit", "doc", "ord", "is_appellate", "decision_date", F.col("sides" if sided else "whole").alias("norms")).where("norms is not null")
        cited = mine.where("is_appellate = 1").select("circuit", "norms", F.col("decision_date").alias("a_date"), F.col("doc").alias("a"))
        probes = cited.select("circuit", "norms", "a_date").distinct()
        district = mine.where("is_appellate = 0").select("circuit", "norms", F.col("decision_date").alias("d_date"), "ord", "doc")
        counts = staged(frequencies(district.select("circuit", F.lit(1).alias("n"), F.explode("norms").alias("norm")), analyze), "terms")
        vocab = weighed(counts, max_df, min_df)
        a_vecs = staged(vectors(probes.select("circuit", F.explode("norms").alias("norm")), vocab, threshold, analyze), "probes")
        a = _with_vectors(probes.select("circuit", "norms").distinct(), a_vecs, sides)
        wanted = probes.select("circuit", F.posexplode("norms").alias("side", "norm")).distinct().join(a_vecs, ["circuit", "norm"]).select("circuit", "side", F.explode("prefix").alias("term")).distinct()
        near = _with_candidates(district, counts, staged(wanted, "prefixes"), sides, threshold, max_df, min_df, analyze)
        indexed = staged(near.groupBy("circuit", "norms", "d_date").agg(F.min(F.struct("ord", "doc")).alias("best")), "indexed")
        d = indexed.select("circuit", "norms").distinct()
        d = _with_vectors(d, vectors(d.select("circuit", F.explode("norms").alias("norm")), vocab, threshold, analyze), sides)
        keys = [f"k{i}" for i in range(sides)]
        b = d.select("circuit", *keys, F.col("norms").alias("d_norms"), *(F.col(f"v{i}").alias(f"d{i}") for i in range(sides)))
        similar = a.join(b, ["circuit", *keys]).select("circuit", "norms", "d_norms", *(_dot(f"v{i}", f"d{i}").alias(f"s{i}") for i in range(sides)))
        if sided:
            similar = similar.where((F.col("s0") >= side_threshold) & (F.col("s1") >= side_threshold)).withColumn("score", (F.col("s0") + F.col("s1")) / 2)
        else:
            similar = similar.withColumn("score", F.col("s0"))
        similar = similar.where(F.col("score") > cutoff).groupBy("circuit", "norms", "d_norms").agg(F.max("score").alias("score"))  # several keys may lead to a pair
        pairs = _first_in_window(probes.join(similar, ["circuit", "norms"]), indexed.withColumnRenamed("norms", "d_norms"), years)
        found = pairs.groupBy("circuit", "norms", "a_date").agg(F.min(F.struct((-F.col("score")).alias("s"), "best")).alias("m"))
        best = cited.alias("x").join(found.alias("y"), F.expr("x.circuit = y.circuit and x.norms = y.norms and x.a_date <=> y.a_date"))
        best = best.select("x.circuit", "a", F.col("m.best.doc").alias("d"), (F.lit(0.0 if sided else bonus) - F.col("m.s")).alias("score"))
        out = best if out is None else out.unionByName(best)
    return out


def _first_in_window(pairs: DataFrame, dated: DataFrame, years: int) -> DataFrame:
    """``pairs(circuit, norms, a_date, d_norms, score)`` with ``best``, the least of ``dated(circuit, d_norms, d_date, best)`` in the ``years`` before ``a_date``.

    Pairs without one are left out; a null ``a_date`` takes any date.  A pair may come twice, of which the lesser ``best`` counts.
    """
    every = dated.groupBy("circuit", "d_norms").agg(F.min("best").alias("best"))
    columns = ["circuit", "norms", "a_date", "score", "best"]
    undated = pairs.where("a_date is null").join(every, ["circuit", "d_norms"]).select(columns)
    pairs, dated = pairs.where("a_date is not null"), dated.where("d_date is not null")
    if years < 1:
        return undated.unionByName(pairs.join(dated.withColumnRenamed("d_date", "a_date"), ["circuit", "d_norms", "a_date"]).select(columns))
    # Each date runs up from the start of its block (+1) and down from its end (-1).
    begin = F.expr(f"a_date - interval {years} years")
    none = lambda frame, *names: [F.lit(None).cast(frame.schema[n].dataType).alias(n) for n in names]
    ends = F.explode(F.array(*(F.struct(F.lit(way).alias("way"), at.alias("at")) for way, at in ((1, F.col("a_date")), (-1, begin)))))
    asked = pairs.select("circuit", "d_norms", "norms", "a_date", "score", *none(dated, "best"), ends.alias("e"))
    held = dated.select("circuit", "d_norms", *none(pairs, "norms", "a_date", "score"), "best", F.explode(F.array(*(F.struct(F.lit(way).alias("way"), F.col("d_date").alias("at")) for way in (1, -1)))).alias("e"))
    events = asked.unionByName(held).select("circuit", "d_norms", "norms", "a_date", "score", "best", "e.way", F.floor(F.year("e.at") / F.lit(years)).alias("block"), (F.col("e.way") * F.unix_micros("e.at")).alias("at"))
    run = Window.partitionBy("circuit", "d_norms", "way", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return undated.unionByName(events.withColumn("best", F.min("best").over(run)).where("norms is not null and best is not null").select(columns))
