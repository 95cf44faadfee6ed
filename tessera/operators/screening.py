"""Candidate retrieval, scoring and ranking over batches of queries.

corpus: name_id, entity_id, normalized, tokens, phonetic, embedding (any may be null), is_active.
queries: query_id, normalized, tokens, sorted_key, phonetic, embedding. Ties are broken by name_id, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import fuzzy, text
from tessera.storage import written

from . import blocks, neighbours

LIMIT, TRIGRAM_THRESHOLD, VECTOR_DISTANCE, SHORT_NAME, IDF_FLOOR = 50, 0.35, 0.35, 2, 2.0
UNKNOWN_BLOCK_IDF, UNKNOWN_WEIGHT_IDF = 99.0, 1.0
# Weights of the name score and of its adjustments.
WEIGHTS = {
    "token_set": 0.35, "token_sort": 0.25, "jaro_winkler": 0.25, "embedding": 0.15, "dob_exact_bonus": 10.0, "dob_year_bonus": 5.0, "dob_conflict_penalty": -25.0,
    "nationality_match_bonus": 5.0, "nationality_conflict_penalty": -10.0, "entity_type_mismatch_penalty": -30.0, "rare_token_missing_penalty": 8.0,
    "rare_token_missing_cap": 25.0, "rare_idf_threshold": 2.0, "weak_alias_cap": 80.0,
}


def token_stats(names: DataFrame, tokens: str = "tokens", distinct: bool = False) -> DataFrame:
    """token, document_frequency, idf = ln(names / occurrences); occurrences count repeats unless distinct."""
    n = names.agg(F.count(F.lit(1)).alias("n_names"))
    each = F.array_distinct(tokens) if distinct else F.col(tokens)
    df = names.select(F.explode(each).alias("token")).where("token is not null and token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("document_frequency"))
    return df.crossJoin(F.broadcast(n)).select("token", "document_frequency", F.log(F.col("n_names") / F.col("document_frequency")).alias("idf"))


def top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= limit)


def by_tokens(queries: DataFrame, corpus: DataFrame, stats: DataFrame, limit: int = LIMIT, floor: float = IDF_FLOOR) -> DataFrame:
    """query_id, name_id, weight: names that share a selective token, weighed by all shared tokens' idf.

    Exact, with bounds: a query's tokens stand in order, rarest first. As soon as one is held by `limit` names, each
    of which weighs its idf or more, names whose first shared token comes later count only while all that is left may
    weigh as much. Queries and names meet in blocks (blocks.py), each with its tokens.
    """
    names = corpus.where("is_active").select(F.col("name_id").alias("id"), F.array_distinct("tokens").alias("tokens"))
    asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token")).where("token <> ''")
    held = names.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("names"))
    asked = asked.join(stats.select("token", "idf"), "token", "left").join(held, "token", "left")
    weight = F.coalesce("idf", F.lit(UNKNOWN_WEIGHT_IDF))
    selective = F.coalesce("idf", F.lit(UNKNOWN_BLOCK_IDF)) >= floor
    whole, later = W.partitionBy("query_id"), W.partitionBy("query_id").orderBy(F.desc("weight"), "token").rowsBetween(0, W.unboundedFollowing)
    asked = asked.withColumn("weight", weight).withColumn("block", selective | ~F.max(selective).over(whole))
    sure = F.max(F.when(F.col("block") & (F.col("names") >= limit), F.col("weight"))).over(whole)
    asked = asked.withColumn("left", F.sum("weight").over(later)).withColumn("block", F.col("block") & (F.col("left") * (1 + 1e-9) >= F.coalesce(sure, F.lit(0.0))))
    entry = F.struct((-F.col("weight")).alias("order"), "token", "block")
    each = asked.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("asked"))
    joined = lambda c: F.array_join(c, blocks.MARK)  # noqa: E731  lists cost far more than strings on their way to Python
    each = each.select("id", joined("asked.token").alias("tokens"), joined(F.transform("asked.order", lambda x: (-x).cast("string"))).alias("weights"), joined(F.transform("asked.block", lambda x: F.when(x, "1").otherwise("0"))).alias("blocks"))
    found = blocks.met(written(each, "asked-tokens"), names.select("id", joined(F.filter("tokens", lambda t: t != "")).alias("tokens")), blocks.weighed(limit), "query_id long, name_id long, weight double", TOKEN_BLOCK, best=blocks.nearest(limit, "weight"))
    return top(written(found, "token-lists"), [F.desc("weight"), F.asc("name_id")], limit)


#: Names of a block that tokens are looked up in.
TOKEN_BLOCK = 1 << 18


def by_trigrams(queries: DataFrame, corpus: DataFrame, limit: int | None = LIMIT, threshold: float = TRIGRAM_THRESHOLD, spelled: bool = False, rate=None, best: int | None = None, bounds=None) -> DataFrame:
    """query_id, name_id, similarity of at least threshold; spelled adds a and b, both names. No limit: all pairs, and no place.

    rate: a ratio of two lists of names in place of the similarity; best: of each query and block of names, the best
    name of so many best entities, which hold those of all names; bounds: what no rate exceeds, so that few are rated.

    Exact: each block of queries meets each of names and counts what they share (blocks.py). Trigrams are few, and at
    such a threshold frequent ones join nearly as many pairs as all do, so adding rows of bytes costs less than joins.
    """
    def sets(df: DataFrame, key: str) -> DataFrame:
        grams = F.array_join(text.trigrams(F.col("normalized")), "").alias("grams")
        return df.select(F.col(key).alias("id"), grams, *([F.col("normalized").alias("name")] if spelled or rate else []), *(["entity_id"] if best and key == "name_id" else []))

    schema = "query_id long, name_id long, similarity double" + (", a string, b string" if spelled else "") + (", entity_id long" if best else "")
    cut = blocks.leading(best) if best else None if limit is None else blocks.nearest(limit, "similarity")
    found = blocks.met(sets(queries, "query_id"), sets(corpus.where("is_active"), "name_id"), blocks.similar(threshold, limit, spelled, rate, best, bounds), schema, deal_by="name" if spelled or rate else "grams", best=cut)
    return found.drop("entity_id") if limit is None else top(written(found, "trigram-lists"), [F.desc("similarity"), F.asc("name_id")], limit)


def by_vectors(queries: DataFrame, corpus: DataFrame, limit: int = LIMIT, max_distance: float = VECTOR_DISTANCE, clustered: bool = True) -> DataFrame:
    """query_id, name_id, distance: the nearest `limit`, of which those nearer than max_distance stay.

    Exact, over a metric partition of the corpus (neighbours.py); vectors that are not clustered, of which a partition rules
    out next to none, meet in blocks. Vectors that are null or empty meet nothing; all others are of one length.
    """
    if not clustered:
        some = lambda df, key: df.where(F.size("embedding") > 0).select(F.col(key).alias("id"), "embedding")
        found = blocks.met(some(queries, "query_id"), some(corpus.where("is_active"), "name_id"), neighbours.near(limit, max_distance), "query_id long, name_id long, distance double", best=blocks.nearest(limit, "distance", -1))
        return top(written(found, "vector-lists"), [F.asc("distance"), F.asc("name_id")], limit).where(F.col("distance") < max_distance)
    cells = neighbours.Cells(corpus.where("is_active"))
    found, _, _ = neighbours.candidates(queries, cells, limit, max_distance)
    return top(found, [F.asc("distance"), F.asc("name_id")], limit).where(F.col("distance") < max_distance)


def by_sound(queries: DataFrame, corpus: DataFrame, limit: int = LIMIT) -> DataFrame:
    """query_id, name_id: names that share a phonetic key, the smallest ids first.

    Of each key only its `limit` smallest ids can be among a query's smallest, so a frequent key joins with no more.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("phonetic")).alias("sound"))
    held = corpus.where("is_active").select("name_id", F.explode(F.array_distinct("phonetic")).alias("sound"))
    least = held.withColumn("r", F.row_number().over(W.partitionBy("sound").orderBy("name_id"))).where(F.col("r") <= limit).drop("r")
    return top(asked.join(least, "sound").select("query_id", "name_id").distinct(), [F.asc("name_id")], limit)


def union_of(*parts: tuple[str, DataFrame]) -> DataFrame:
    """query_id, name_id, methods, first_seen: each candidate once, in order of first method and place, with all its methods."""
    every = None
    for rank, (method, df) in enumerate(parts):
        one = df.select("query_id", "name_id", F.lit(method).alias("method"), F.lit(rank).alias("rank"), "place")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("query_id", "name_id").agg(F.array_sort(F.collect_set("method")).alias("methods"), F.min(F.struct("rank", "place")).alias("first_seen"))


def candidates(queries: DataFrame, corpus: DataFrame, stats: DataFrame, vectors: bool = True) -> DataFrame:
    """The union of all retrievers; sound only for short names, vectors only when asked for."""
    parts = [("token", by_tokens(queries, corpus, stats)), ("trigram", by_trigrams(queries, corpus))]
    if vectors:
        parts.append(("vector", by_vectors(queries, corpus, clustered=False)))  # hashed names have few clusters
    parts.append(("phonetic", by_sound(queries.where(F.size("tokens") <= SHORT_NAME), corpus)))
    return union_of(*parts)


def name_score(set_: Column, sort_: Column, jw: Column, cosine: Column, w: dict[str, float] = WEIGHTS) -> Column:
    """The weighted ratios; without a cosine the other weights are scaled up to one."""
    plain = w["token_set"] * set_ + w["token_sort"] * sort_ + w["jaro_winkler"] * jw
    rest = w["token_set"] + w["token_sort"] + w["jaro_winkler"]
    return F.when(cosine.isNull(), plain / rest).otherwise(plain + w["embedding"] * cosine)


def rare_penalty(query_tokens: Column, rare: Column, candidate_tokens: Column, w: dict[str, float] = WEIGHTS) -> Column:
    """Minus what each of the query's rare tokens that the candidate lacks costs; repeats count."""
    missing = F.size(F.filter(query_tokens, lambda t: F.array_contains(rare, t) & ~F.array_contains(candidate_tokens, t)))
    return -F.least(missing * w["rare_token_missing_penalty"], F.lit(w["rare_token_missing_cap"]))


def adjustments(birth: Column, nationality: Column, id_number: Column, query_type: Column, entity: dict[str, Column], w: dict[str, float] = WEIGHTS) -> tuple[Column, Column]:
    """(map of adjustments, forced): entity has dobs, dob_years, nationalities, id_numbers, sdn_type.

    An equal identifier forces the result and leaves the other adjustments out.
    """
    plain = lambda c: F.lower(F.trim(c))
    forced = F.coalesce((F.trim(id_number) != "") & F.exists(entity["id_numbers"], lambda i: F.upper(F.trim(i)) == F.upper(F.trim(id_number))), F.lit(False))
    gap = F.array_min(F.transform(entity["dob_years"], lambda y: F.abs(F.year(birth) - y)))
    dob = (
        F.when(F.array_contains(entity["dobs"], birth), F.struct(F.lit("dob_exact_match"), F.lit(w["dob_exact_bonus"])))
        .when(F.array_contains(entity["dob_years"], F.year(birth)), F.struct(F.lit("dob_year_match"), F.lit(w["dob_year_bonus"])))
        .when(gap > 2, F.struct(F.lit("dob_conflict"), F.lit(w["dob_conflict_penalty"])))
    )
    has_nation = (plain(nationality) != "") & (F.size(entity["nationalities"]) > 0)
    same = F.exists(entity["nationalities"], lambda n: plain(n) == plain(nationality))
    nation = F.when(has_nation & same, F.struct(F.lit("nationality_match"), F.lit(w["nationality_match_bonus"]))).when(has_nation, F.struct(F.lit("nationality_conflict"), F.lit(w["nationality_conflict_penalty"])))
    kind = F.when((query_type == "individual") != (entity["sdn_type"] == "Individual"), F.struct(F.lit("entity_type_mismatch"), F.lit(w["entity_type_mismatch_penalty"])))
    found = F.array_compact(F.array(dob, nation, kind))
    empty = F.map_from_entries(F.filter(found, lambda _: F.lit(False)))
    return F.when(forced, empty).otherwise(F.map_from_entries(found)), forced


def composite(score: Column, changes: Column, forced: Column, weak: Column, w: dict[str, float] = WEIGHTS) -> Column:
    """100 when forced; else the adjusted score, a weak alias capped, held in 0 to 100, two digits."""
    total = score + F.aggregate(F.map_values(changes), F.lit(0.0), lambda s, x: s + x)
    capped = F.when(F.coalesce(weak, F.lit(False)), F.least(total, F.lit(w["weak_alias_cap"]))).otherwise(total)
    return F.when(forced, F.lit(100.0)).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), capped)), 2))


#: What a query may say of a person, and an entity's attributes; absent ones are null or empty and change nothing.
QUERY_FACTS = {"birth": "date", "nationality": "string", "id_number": "string", "query_type": "string"}
ENTITY_FACTS = {"dobs": "array<date>", "dob_years": "array<int>", "nationalities": "array<string>", "id_numbers": "array<string>", "sdn_type": "string", "weak": "boolean"}


def with_facts(df: DataFrame, facts: dict[str, str]) -> DataFrame:
    """df with a null column for each fact that it has not."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in facts.items() if name not in df.columns})


def scored(found: DataFrame, queries: DataFrame, corpus: DataFrame, stats: DataFrame) -> DataFrame:
    """Candidates with their ratios, cosine, adjustments and composite score; the Arrow functions see blocked pairs only.

    queries may have QUERY_FACTS, corpus ENTITY_FACTS. corroborated: birth, nationality or an identifier agrees.
    """
    rare = stats.where(F.col("idf") > WEIGHTS["rare_idf_threshold"]).select("token")
    q = with_facts(with_facts(queries, QUERY_FACTS), {"embedding": "array<float>"}).select("query_id", F.col("normalized").alias("q_name"), F.col("tokens").alias("q_tokens"), F.col("sorted_key").alias("q_key"), F.col("embedding").alias("q_vector"), *QUERY_FACTS)
    rare_of = q.select("query_id", F.explode(F.array_distinct("q_tokens")).alias("token")).join(rare, "token", "left_semi").groupBy("query_id").agg(F.collect_set("token").alias("rare"))
    q = q.join(rare_of, "query_id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))
    c = with_facts(with_facts(corpus, ENTITY_FACTS), {"embedding": "array<float>"}).select("name_id", "entity_id", F.col("normalized").alias("c_name"), F.col("tokens").alias("c_tokens"), F.col("embedding").alias("c_vector"), *ENTITY_FACTS)
    pairs = found.join(q, "query_id").join(c, "name_id")
    both = (F.size("q_vector") > 0) & (F.size("c_vector") > 0)
    pairs = pairs.withColumns({
        "set_ratio": fuzzy.token_set_ratio("q_name", "c_name"), "sort_ratio": fuzzy.token_sort_ratio("q_name", "c_name"),
        "jw_ratio": fuzzy.jaro_winkler_ratio(F.col("q_key"), F.array_join(F.array_sort("c_tokens"), " ")),
        "cosine": F.when(both, 100 * text.clamped_dot(F.col("q_vector"), F.col("c_vector"))),
    })
    none = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind))
    entity = {name: F.col(name) if name in ("sdn_type", "weak") else none(name, kind) for name, kind in ENTITY_FACTS.items()}
    changes, forced = adjustments(F.col("birth"), F.col("nationality"), F.col("id_number"), F.col("query_type"), entity)
    base = name_score(F.col("set_ratio"), F.col("sort_ratio"), F.col("jw_ratio"), F.col("cosine"))
    penalty = rare_penalty(F.col("q_tokens"), F.col("rare"), F.col("c_tokens"))
    pairs = pairs.withColumns({"base": base, "penalty": penalty, "changes": changes, "forced": forced})
    agrees = F.exists(F.map_keys("changes"), lambda k: k.isin("dob_exact_match", "dob_year_match", "nationality_match"))
    return pairs.select(
        "query_id", "name_id", "entity_id", "methods", "set_ratio", "sort_ratio", "jw_ratio", "cosine", F.col("penalty").alias("rare_penalty"), F.col("changes").alias("adjustments"), "forced",
        (F.col("forced") | agrees).alias("corroborated"), composite(F.col("base") + F.col("penalty"), F.col("changes"), F.col("forced"), F.col("weak")).alias("score"),
    )


def ranked(scores: DataFrame, top_n: int = 10) -> DataFrame:
    """The best name of each entity, then the best entities of each query."""
    best = scores.withColumn("r", F.row_number().over(W.partitionBy("query_id", "entity_id").orderBy(F.desc("score"), F.asc("name_id")))).where("r = 1").drop("r")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("entity_id")))
    return best.withColumn("rank", place).where(F.col("rank") <= top_n)


def bound(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it, also inside other lambdas."""
    return F.transform(F.array(x), f)[0]


def hashed_embedding(c: Column, dim: int = 64) -> Column:
    """A stand-in for a language model: unit vectors of hashed character trigrams; an empty text gives an empty vector."""
    slots = F.transform(text.trigrams(c), lambda g: F.pmod(F.xxhash64(g), F.lit(dim)).cast("int"))
    counts = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))
    norm = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda raw: bound(norm(raw), lambda n: F.transform(raw, lambda x: (x / n).cast("float")))
    return bound(slots, lambda s: F.when(F.size(s) > 0, bound(counts(s), unit)).otherwise(F.array().cast("array<float>")))


# Spellings that a true match may be written in, one for another.
VARIANTS = (
    ("MOHAMMAD", "MOHAMMED"), ("MOHAMMED", "MUHAMMAD"), ("MUHAMMAD", "MOHAMAD"), ("ABDUL", "ABD AL"), ("HUSSEIN", "HUSSAIN"), ("HUSSAIN", "HUSAIN"), ("YUSUF", "YOUSEF"),
    ("YOUSEF", "YUSUF"), ("IBRAHIM", "EBRAHIM"), ("OSAMA", "USAMA"), ("ALI", "ALY"), ("AHMED", "AHMAD"), ("AHMAD", "AHMED"),
)


def perturbed(c: Column, key: Column, seed: int = 42) -> Column:
    """A spelling of the name that a rule by key and seed picks: a spelling variant, reordered, a middle word dropped,
    two letters of a word swapped, or an honorific before it; what can't be applied leaves the name as it is."""
    words = F.split(c, " ")
    draw = lambda k, n: F.pmod(F.xxhash64(key, F.lit(seed + k)), n).cast("int")
    n, pick = F.size(words), draw(0, F.lit(5))
    variants = F.create_map(*[F.lit(x) for pair in VARIANTS for x in pair])
    respelled = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(variants, F.upper(w)), w)), " ")
    middle = draw(1, F.greatest(n - 2, F.lit(1))) + 1
    dropped = F.array_join(F.filter(words, lambda _, i: ~((i == middle) & (n >= 3))), " ")
    at = draw(2, n)
    place = draw(3, F.greatest(F.length(F.get(words, at)) - 2, F.lit(1))) + 2
    swap = lambda w: F.when(F.length(w) < 4, w).otherwise(F.concat(F.substr(w, F.lit(1), place - 1), F.substr(w, place + 1, F.lit(1)), F.substr(w, place, F.lit(1)), F.substr(w, place + 2)))
    swapped = F.array_join(F.transform(words, lambda w, i: F.when(i == at, swap(w)).otherwise(w)), " ")
    return F.when(pick == 0, respelled).when(pick == 1, F.array_join(F.reverse(words), " ")).when(pick == 2, dropped).when(pick == 3, swapped).otherwise(F.concat(F.lit("Dr "), c))


#: How many rows of each label an evaluation takes, and the syllables of made-up names.
EVALUATED = {"true_match": 220, "hard_negative": 90, "clean": 140}
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu".split()


def evaluation_set(names: DataFrame, counts: dict[str, int] = EVALUATED, seed: int = 42) -> DataFrame:
    """query_id, label, true_entity, raw, year, true_name: as many rows of each label as counts say; fewer names give fewer rows.

    names (name_id, entity_id, raw, year, and last_year where several entities bear a name), in an order by seed: true
    matches are respelled and half of them keep their year, hard negatives have a year that conflicts with every bearer
    of the name, clean names are made of syllables.
    """
    draw = lambda k, *c: F.xxhash64(*c, F.lit(seed + k))
    first, second = counts["true_match"], counts["hard_negative"]
    order = [draw(0, "name_id"), F.col("name_id")]
    place = F.row_number().over(W.orderBy(*order))  # over the limit's rows, a fixed number
    picked = names.orderBy(*order).limit(first + second).withColumn("place", place)
    hit = F.col("place") <= first
    last = F.col("last_year" if "last_year" in names.columns else "year")
    year = F.when(hit, F.when(draw(5, "name_id") % 2 == 0, F.col("year"))).otherwise(last + 15 + F.pmod(draw(6, "name_id"), F.lit(26)).cast("int"))
    real = picked.select(
        F.col("place").cast("long").alias("query_id"), F.when(hit, "true_match").otherwise("hard_negative").alias("label"), F.when(hit, F.col("entity_id")).alias("true_entity"),
        F.when(hit, perturbed(F.col("raw"), F.col("name_id"), seed)).otherwise(F.col("raw")).alias("raw"), year.cast("int").alias("year"), F.when(hit, F.col("raw")).alias("true_name"))
    syllable = lambda k: F.get(F.array(*map(F.lit, SYLLABLES)), F.pmod(draw(10 + k, "id"), F.lit(len(SYLLABLES))).cast("int"))
    word = lambda k: F.concat(*[syllable(4 * k + i) for i in range(4)])
    clean = names.sparkSession.range(counts["clean"]).select(
        (F.col("id") + first + second + 1).alias("query_id"), F.lit("clean").alias("label"), F.lit(None).cast("long").alias("true_entity"), F.concat_ws(" ", word(0), word(1)).alias("raw"), F.lit(None).cast("int").alias("year"),
        F.lit(None).cast("string").alias("true_name"))
    return real.unionByName(clean)


def baseline(found: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, entity_id, score: the candidate with the best token set ratio alone; of equal ones the smallest name_id."""
    pairs = found.join(queries.select("query_id", F.col("normalized").alias("q_name")), "query_id").join(corpus.select("name_id", "entity_id", F.col("normalized").alias("c_name")), "name_id")
    rated = pairs.select("query_id", "entity_id", "name_id", fuzzy.token_set_ratio("q_name", "c_name").alias("score")).where("score > 0")
    best = F.max(F.struct("score", (-F.col("name_id")).alias("order"), "entity_id"))
    return rated.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.entity_id", "b.score")
