"""Names, corpora, retrieval, scoring and the flagship batch screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fuzzy, text
from tessera.operators import decisions as D
from tessera.operators import rescreen as R
from tessera.operators import screening as S
from tessera.session import table
from tessera.storage import written

from .registry import query

#: Every line of every whole text opens with a name, its first NAME_WORDS words; a document is an entity and its lines' names are its own.
NAME_WORDS = 3
#: A name's id is its document's times LINES plus its line's number, from 0.
LINES = 1 << 32
#: The documents whose names are asked for, too.
ASKED_EVERY = 50
BLANKS = r"[\x20\x09-\x0D]+"


def watch_names(spark, d, *more):
    """The watchlist: name_id, entity_id, normalized, tokens, sorted_key, is_active, more columns of documents; some 88,000 names for 10,000 documents, ties kept."""
    lines = table(spark, d, "documents").select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("line", "words"))
    words = lines.select("doc_id", *more, "line", F.slice(F.filter(F.split("words", BLANKS), lambda w: w != ""), 1, NAME_WORDS).alias("w")).where(F.size("w") == NAME_WORDS)
    raw = words.select((F.col("doc_id") * LINES + F.col("line")).alias("name_id"), F.col("doc_id").alias("entity_id"), *more, F.array_join("w", " ").alias("raw"))
    return text.with_name(raw, F.col("raw")).where("normalized <> ''").withColumn("is_active", F.lit(True))


def asked_names(names):
    """Every fiftieth entity's names, as queries against all."""
    return names.where(F.col("entity_id") % ASKED_EVERY == 0).withColumnRenamed("name_id", "query_id").drop("entity_id", "is_active", "raw")


def listed(words):
    return ", ".join(f"'{w}'" for w in words)


LETTERS = "strip_accents(raw)"
for two, one in text.DIGRAPHS.items():
    LETTERS = f"replace({LETTERS}, '{two}', '{one}')"
RESPELLED = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.SPELLINGS.items())
SQL_NAMES = rf"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
texts AS (SELECT doc_id, i, list_filter(regexp_split_to_array(l, '{BLANKS}'), lambda x: x <> '') AS w FROM lines),
cut AS (SELECT doc_id, doc_id * {LINES} + i AS name_id, array_to_string(w[1:{NAME_WORDS}], ' ') AS raw FROM texts WHERE len(w) >= {NAME_WORDS}),
plain AS (SELECT *, trim(regexp_replace(regexp_replace(replace(upper(regexp_replace({LETTERS}, '[^\x00-\x7F]', '', 'g')), '.', ''), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM cut),
split AS (SELECT name_id, doc_id AS entity_id, list_transform(list_filter(string_split(p, ' '), lambda x: x NOT IN ('', {listed(text.HONORIFICS)})),
  lambda x: CASE WHEN x IN ({listed(text.LEGAL_FORMS)}) THEN '{text.LEGAL_TOKEN}' ELSE CASE x {RESPELLED} ELSE x END END) AS tokens FROM plain),
names AS (SELECT *, array_to_string(tokens, ' ') AS normalized FROM split WHERE len(tokens) > 0),
asked AS (SELECT name_id AS query_id, tokens, normalized FROM names WHERE entity_id % {ASKED_EVERY} = 0)
"""


@query("normalize_tokens", """
WITH n AS (SELECT p_partkey, upper(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ', L.L.C' WHEN 2 THEN ' Dr' ELSE '' END AS raw FROM part),
t AS (SELECT p_partkey, list_filter(string_split(trim(regexp_replace(regexp_replace(replace(upper(raw), '.', ''), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x NOT IN ('', 'DR', 'MR', 'ENG')) AS w FROM n),
m AS (SELECT p_partkey, list_transform(w, lambda x: CASE WHEN x IN ('LTD', 'LLC', 'CO', 'SA', 'INC', 'AG') THEN 'SUFFIXCORP' ELSE x END) AS w FROM t)
SELECT p_partkey, array_to_string(w, ' ') AS normalized, array_to_string(list_sort(w), ' ') AS sorted_key FROM m""")
def normalize_tokens(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.concat("p_name", F.when(k == 0, " Ltd.").when(k == 1, ", L.L.C").when(k == 2, " Dr").otherwise(""))
    n = text.normalized(raw)
    return table(spark, d, "part").select("p_partkey", n["normalized"].alias("normalized"), n["sorted_key"].alias("sorted_key"))


@query("strip_accents", "SELECT doc_id, md5(strip_accents(replace(replace(text, 'ß', 'ss'), 'ẞ', 'SS'))) AS plain FROM documents")
def strip_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("plain"))


@query("name_length_stats", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents)
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM w""")
def name_length_stats(spark, d):
    t = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("token_idf", """
WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM documents)
SELECT token, count(*) AS document_frequency, round(ln((SELECT count(*) FROM documents) / CAST(count(*) AS DOUBLE)), 6) AS idf FROM t GROUP BY 1""")
def token_idf(spark, d):
    t = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    return S.token_stats(table(spark, d, "documents").select(t.alias("tokens"))).withColumn("idf", F.round("idf", 6))


@query("token_block_topk", f"""
WITH {SQL_NAMES},
tok AS (SELECT name_id, unnest(list_distinct(tokens)) AS token FROM names),
stats AS (SELECT token, ln((SELECT count(*) FROM names) / CAST(count(*) AS DOUBLE)) AS idf FROM (SELECT unnest(tokens) AS token FROM names) GROUP BY 1),
one AS (SELECT query_id, unnest(list_distinct(tokens)) AS token FROM asked),
q AS (SELECT query_id, token, idf, max(CASE WHEN idf >= 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_sel FROM one JOIN stats USING (token)),
b AS (SELECT DISTINCT query_id, t.name_id FROM q JOIN tok t USING (token) WHERE idf >= 2.0 OR any_sel = 0),
w AS (SELECT b.query_id, b.name_id, sum(q.idf) AS weight FROM b JOIN q ON q.query_id = b.query_id JOIN tok t ON t.name_id = b.name_id AND t.token = q.token GROUP BY 1, 2)
SELECT query_id, name_id, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, name_id) AS r FROM w) WHERE r <= 10""")
def token_block_topk(spark, d):
    """The ten best names by shared tokens of every name that is asked for."""
    names = written(watch_names(spark, d), "names")
    return S.by_tokens(asked_names(names), names, S.token_stats(names), limit=10).select("query_id", "name_id", F.round("weight", 6).alias("weight"))


SQL_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: list_transform(range(1, len(x) + 2), lambda i: substr('  ' || x || ' ', i, 3)))))"
#: Pairs of an asked name and any name, by all trigrams they share.
SQL_SIMILAR = f"""
grams AS (SELECT name_id, normalized, {SQL_GRAMS.format('normalized')} AS g FROM names),
one_gram AS (SELECT name_id, unnest(g) AS gram FROM grams),
asked_gram AS (SELECT query_id, unnest({SQL_GRAMS.format('normalized')}) AS gram FROM asked),
shared AS (SELECT query_id, name_id, count(*) AS n FROM asked_gram JOIN one_gram USING (gram) GROUP BY 1, 2),
alike AS (SELECT query_id, s.name_id, a.normalized AS a, b.normalized AS b, n / CAST(len(a.g) + len(b.g) - n AS DOUBLE) AS similarity
  FROM shared s JOIN grams a ON a.name_id = query_id JOIN grams b ON b.name_id = s.name_id WHERE n / CAST(len(a.g) + len(b.g) - n AS DOUBLE) >= 0.35)
"""


@query("trigram_join", f"""
WITH {SQL_NAMES}, {SQL_SIMILAR}
SELECT query_id, name_id, round(similarity, 6) AS similarity FROM alike""")
def trigram_join(spark, d):
    names = written(watch_names(spark, d), "names")
    return S.by_trigrams(asked_names(names), names, limit=None).select("query_id", "name_id", F.round("similarity", 6).alias("similarity"))


@query("vector_topk", """
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS name_id, 1 - list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS distance FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, name_id) AS place FROM s)
SELECT query_id, name_id, round(distance, 6) + 0 AS distance FROM r WHERE place <= 50 AND distance < 0.75 AND query_id <> name_id""")
def vector_topk(spark, d):
    """The fifty nearest vectors of each query vector; the queries are the ids divisible by fifty."""
    e = table(spark, d, "embeddings")
    corpus = e.select(F.col("vec_id").alias("name_id"), "embedding", F.lit(True).alias("is_active"))
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return S.by_vectors(queries, corpus, 50, 0.75).where("query_id <> name_id").select("query_id", "name_id", (F.round("distance", 6) + 0).alias("distance"))


@query("vector_dot_clamped", """
WITH s AS (SELECT label, avg(v) AS c, i FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
c AS (SELECT label, list(c ORDER BY i) AS c FROM s GROUP BY label)
SELECT vec_id, round(greatest(0, least(1, list_dot_product(embedding::DOUBLE[], c::DOUBLE[]))), 6) + 0 AS dot FROM embeddings JOIN c USING (label)""")
def vector_dot_clamped(spark, d):
    """Each vector against its label's centre."""
    e = table(spark, d, "embeddings")
    centre = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("c")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("centre"))
    return e.join(centre, "label").select("vec_id", (F.round(text.clamped_dot(F.col("embedding"), F.col("centre")), 6) + 0).alias("dot"))


@query("phonetic_block")
def phonetic_block(spark, d):
    """Names that share a NYSIIS or Metaphone key with an asked one, the fifty of least id; DuckDB has no such function."""
    names = written(watch_names(spark, d).withColumn("phonetic", fuzzy.phonetic_keys("tokens")), "names")
    return S.by_sound(asked_names(names), names).select("query_id", "name_id")


@query("phonetic_codes")
def phonetic_codes(spark, d):
    words = watch_names(spark, d).select(F.explode("tokens").alias("word")).distinct()
    return words.select("word", F.soundex("word").alias("soundex"), fuzzy.nysiis_code("word").alias("nysiis"), fuzzy.metaphone_code("word").alias("metaphone"))


#: The fifty best names of each asked one by trigrams and by tokens, united with the methods that found them.
SQL_UNITED = """
tri AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, name_id) AS place FROM alike),
tok AS (SELECT name_id, unnest(list_distinct(tokens)) AS token FROM names),
stats AS (SELECT token, ln((SELECT count(*) FROM names) / CAST(count(*) AS DOUBLE)) AS idf FROM (SELECT unnest(tokens) AS token FROM names) GROUP BY 1),
one AS (SELECT query_id, unnest(list_distinct(tokens)) AS token FROM asked),
q AS (SELECT query_id, token, idf, max(CASE WHEN idf >= 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_sel FROM one JOIN stats USING (token)),
b AS (SELECT DISTINCT query_id, t.name_id FROM q JOIN tok t USING (token) WHERE idf >= 2.0 OR any_sel = 0),
w AS (SELECT b.query_id, b.name_id, round(sum(q.idf), 9) AS weight FROM b JOIN q ON q.query_id = b.query_id JOIN tok t ON t.name_id = b.name_id AND t.token = q.token GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, name_id) AS place FROM w),
u AS (SELECT query_id, name_id, 'trigram' AS m FROM tri WHERE place <= 50 UNION ALL SELECT query_id, name_id, 'token' FROM best WHERE place <= 50)
SELECT query_id, name_id, array_to_string(list_sort(list(m)), ',') AS methods FROM u GROUP BY 1, 2"""


@query("candidate_union", f"WITH {SQL_NAMES}, {SQL_SIMILAR}, {SQL_UNITED}")
def candidate_union(spark, d):
    """The engine's token and trigram retrievers, fifty names each, united with the methods that found a name."""
    names = written(watch_names(spark, d), "names")
    q = asked_names(names)
    out = S.union_of(("token", S.by_tokens(q, names, S.token_stats(names))), ("trigram", S.by_trigrams(q, names)))
    return out.select("query_id", "name_id", F.array_join("methods", ",").alias("methods"))


#: A later state of the watchlist: some documents' names gone, some with another word, some new; the earlier one lacks the new ones.
#: Rows that are held of a list whose best S.LIMIT count.
HELD = 2 * S.LIMIT
LEFT, ALTERED, CAME = (f"{{}} % 40 = {k}" for k in (7, 9, 11))
SQL_LATER = SQL_NAMES.replace("FROM texts WHERE len(w)", f"FROM texts WHERE NOT ({LEFT.format('doc_id')}) AND len(w)").replace(
    f"array_to_string(w[1:{NAME_WORDS}], ' ') AS raw", f"array_to_string(w[1:{NAME_WORDS}], ' ') || CASE WHEN {ALTERED.format('doc_id')} THEN ' revised' ELSE '' END AS raw")


@query("rescreen_delta", f"WITH {SQL_LATER}, {SQL_SIMILAR}, {SQL_UNITED}")
def rescreen_delta(spark, d):
    """Best lists of an earlier watchlist, renewed by what changed alone: those of a whole screening of the later one."""
    names = written(watch_names(spark, d), "names")
    is_ = lambda rule: F.expr(rule.format("entity_id"))
    spelled = names.where(~is_(LEFT)).select("name_id", "entity_id", "is_active", F.when(is_(ALTERED), F.concat("raw", F.lit(" revised"))).otherwise(F.col("raw")).alias("raw"))
    before, after = names.where(~is_(CAME)), written(text.with_name(spelled, F.col("raw")).where("normalized <> ''"), "later-names")
    changed = names.where(is_(LEFT) | is_(ALTERED) | is_(CAME)).select("name_id")
    asked, stats = asked_names(after), written(S.token_stats(after), "later-stats")
    state = written(R.best_lists(asked, before, stats, ("token", "trigram"), HELD), "lists")
    lists, _ = R.renewed(state, asked, after, changed, stats, ("token", "trigram"), held=HELD)
    return R.candidates(lists).select("query_id", "name_id", F.array_join("methods", ",").alias("methods"))


def name_pairs(spark, d, rate, best=None, bounds=None):
    """Pairs of an asked name and a name that trigrams bring together, rated; each two spellings of a block once."""
    names = written(watch_names(spark, d), "names")
    return S.by_trigrams(asked_names(names), names, limit=None, rate=rate, best=best, bounds=bounds).withColumnRenamed("similarity", "rate")


@query("jaro_winkler_pairs", f"""
WITH {SQL_NAMES}, {SQL_SIMILAR}
SELECT query_id, name_id, round(jaro_winkler_similarity(a, b) * 100, 4) AS jw FROM alike""")
def jaro_winkler_pairs(spark, d):
    return name_pairs(spark, d, fuzzy.winkler_ratios).select("query_id", "name_id", F.round("rate", 4).alias("jw"))


@query("ranked_entities", f"""
WITH {SQL_NAMES}, {SQL_SIMILAR},
rated AS (SELECT query_id, name_id, name_id // {LINES} AS entity_id, round(jaro_winkler_similarity(a, b) * 100, 4) AS score FROM alike),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY score DESC, name_id) AS r FROM rated) WHERE r = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM best)
SELECT query_id, rank, entity_id, name_id, score FROM placed WHERE rank <= 10""")
def ranked_entities(spark, d):
    """Each asked name's ten best entities by the best Jaro-Winkler ratio of their names."""
    rated = name_pairs(spark, d, lambda a, b: fuzzy.half_up(fuzzy.winkler_ratios(a, b), 4), best=10, bounds=fuzzy.winkler_bounds).select("query_id", "name_id", F.shiftright("name_id", 32).alias("entity_id"), F.col("rate").alias("score"))
    return S.ranked(rated).select("query_id", "rank", "entity_id", "name_id", "score")


@query("token_sort_pairs")
def token_sort_pairs(spark, d):
    return name_pairs(spark, d, fuzzy.sort_ratios).select("query_id", "name_id", F.round("rate", 4).alias("token_sort"))


@query("token_set_pairs")
def token_set_pairs(spark, d):
    return name_pairs(spark, d, fuzzy.set_ratios).select("query_id", "name_id", F.round("rate", 4).alias("token_set"))


@query("secondary_adjust", """
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 100.0 ELSE
  (CASE WHEN year(o_orderdate) = 1990 + c_nationkey % 10 THEN 5 WHEN abs(year(o_orderdate) - 1990 - c_nationkey % 10) > 2 THEN -25 ELSE 0 END
   + CASE WHEN o_custkey % 4 = c_nationkey % 4 THEN 5 ELSE -10 END + CASE WHEN (o_custkey % 2 = 0) <> (c_nationkey % 2 = 0) THEN -30 ELSE 0 END)::DOUBLE END AS total
FROM orders JOIN customer ON c_custkey = o_custkey""")
def secondary_adjust(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    key = F.col("o_orderkey")
    entity = {
        "dobs": F.array().cast("array<date>"), "dob_years": F.array((1990 + F.col("c_nationkey") % 10).cast("int")), "nationalities": F.array((F.col("c_nationkey") % 4).cast("string")),
        "id_numbers": F.array(F.when(key % 50 == 0, F.lit(" x1 ")).otherwise("other")), "sdn_type": F.when(F.col("c_nationkey") % 2 == 0, "Individual").otherwise("Entity"),
    }
    changes, forced = S.adjustments(F.to_date("o_orderdate"), (F.col("o_custkey") % 4).cast("string"), F.lit("X1"), F.when(F.col("o_custkey") % 2 == 0, "individual").otherwise("entity"), entity)
    total = F.when(forced, F.lit(100.0)).otherwise(F.aggregate(F.map_values(changes), F.lit(0.0), lambda s, x: s + x))
    return o.select("o_orderkey", total.alias("total"))


@query("rare_token_penalty", """
WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark),
c AS (SELECT token FROM (SELECT unnest(w) AS token, item_id FROM t) GROUP BY 1 HAVING ln((SELECT count(*) FROM t) / CAST(count(*) AS DOUBLE)) > 2.0),
u AS (SELECT item_id, unnest(w) AS token FROM t),
r AS (SELECT item_id, count(*) AS n FROM u JOIN c USING (token) WHERE length(token) > 5 GROUP BY 1)
SELECT item_id, CAST(-least(coalesce(n, 0) * 8, 25) AS DOUBLE) AS penalty FROM t LEFT JOIN r USING (item_id)""")
def rare_token_penalty(spark, d):
    """Benchmark items against candidates that hold only their tokens of up to five letters."""
    w = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    b = table(spark, d, "benchmark").select("item_id", w.alias("tokens"))
    rare = S.token_stats(b).where("idf > 2.0").select("token")
    held = b.select("item_id", F.explode(F.array_distinct("tokens")).alias("token")).join(rare, "token", "left_semi").groupBy("item_id").agg(F.collect_set("token").alias("rare"))
    b = b.join(held, "item_id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))
    return b.select("item_id", S.rare_penalty(F.col("tokens"), F.col("rare"), F.filter("tokens", lambda x: F.length(x) <= 5)).alias("penalty"))


@query("argmax_per_query", """
WITH t AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 9))) AS token FROM benchmark),
dt AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 9))) AS token FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS n FROM t JOIN dt USING (token) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS k FROM s)
SELECT b.item_id, r.doc_id, coalesce(r.n, 0) AS n FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND k = 1""")
def argmax_per_query(spark, d):
    """The document with the most long words in common, for every benchmark item; none gives 0."""
    long = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) > 9))
    b = table(spark, d, "benchmark")
    t = b.select("item_id", F.explode(long).alias("token"))
    docs = table(spark, d, "documents").select("doc_id", F.explode(long).alias("token")).join(t.select("token").distinct(), "token", "left_semi")
    n = t.join(docs, "token").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("item_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "doc_id")).alias("b")).select("item_id", "b.doc_id", (-F.col("b.m")).alias("n"))
    return b.select("item_id").join(best, "item_id", "left").select("item_id", "doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("perturb_sample")
def perturb_sample(spark, d):
    """Spellings by rule of every part name, classed by hash order: a seeded evaluation set."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    kind = F.when(F.pmod(F.xxhash64("p_partkey", F.lit(42)), F.lit(450)) < 220, "true_match").when(F.pmod(F.xxhash64("p_partkey", F.lit(42)), F.lit(450)) < 310, "hard_negative").otherwise("clean")
    year = 1950 + F.pmod(F.xxhash64("p_partkey"), F.lit(50)).cast("int")
    wrong = year + 15 + F.pmod(F.xxhash64("p_partkey", F.lit(7)), F.lit(26)).cast("int")
    return p.select("p_partkey", kind.alias("label"), S.perturbed(F.col("p_name"), F.col("p_partkey")).alias("query_name"), F.when(kind == "hard_negative", wrong).otherwise(year).alias("dob_year"))


def watch_corpus(spark, d):
    """(names, corpus): a document is an entity, its language says what kind it is, its id gives birth, nation and identifier.

    Both are of one table, so documents are read once."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation"))
    names = watch_names(spark, d, "lang")
    e = F.col("entity_id")
    year = (1950 + e % 45).cast("int")
    facts = names.join(nations, e % 25 == F.col("key"), "left").withColumns({
        "phonetic": fuzzy.phonetic_keys("tokens"), "embedding": S.hashed_embedding(F.col("normalized")), "dob_years": F.array(year),
        "dobs": F.when(e % 3 == 0, F.array(F.make_date(year, (e % 12 + 1).cast("int"), (e % 28 + 1).cast("int")))), "nationalities": F.array_compact(F.array("nation")),
        "id_numbers": F.when(e % 4 == 0, F.array(F.concat(F.lit("ID"), e.cast("string")))), "sdn_type": F.when(F.col("lang") == "en", "Individual").otherwise("Entity"),
        "weak": F.col("name_id") % LINES % 6 == 5,
    })
    corpus = written(facts.drop("lang", "key", "nation"), "corpus")
    return corpus.select("name_id", "entity_id", "raw"), corpus.drop("raw")


def screening_tables(spark, d):
    """(queries, corpus) of the flagship: respelled names of every fiftieth document against all names.

    A query carries what the customer of the same key says; the customer's balance, nation and orders give risk and documents.
    """
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation"))
    (names, corpus), e = watch_corpus(spark, d), F.col("entity_id")
    late = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("worst"), F.count(F.lit(1)).alias("n_orders"))
    customer = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("key"), "left").join(late, F.col("c_custkey") == F.col("o_custkey"), "left")
    countries = spark.createDataFrame([(c.upper(), r) for c, r in D.COUNTRY_RISK], "country string, risk_level string")
    document = F.when((F.col("worst") == 2) & (F.col("n_orders") > 20), "fail").when(F.col("worst") == 2, "warn").otherwise("pass")
    rated = D.customer_risk(customer.select(
        "c_custkey", F.col("nation").alias("nationality"), F.col("nation").alias("residence_country"), F.col("c_mktsegment").alias("occupation"), (F.col("c_acctbal") * 12).alias("expected_monthly_volume"),
        F.when(F.col("c_mktsegment") == "BUILDING", "entity").otherwise("individual").alias("customer_type"), document.alias("document_check_status")), countries)
    spelled = names.where(e % ASKED_EVERY == 0).select(F.col("name_id").alias("query_id"), "entity_id", S.perturbed(F.col("raw"), F.col("name_id")).alias("raw"))
    asked = text.with_name(spelled, F.col("raw"))
    k = F.col("query_id") % LINES % 6
    born = (1950 + e % 45 + F.when(k == 1, 1).when(k == 2, 12).otherwise(0)).cast("int")
    queries = asked.join(rated.select(F.col("c_custkey").alias("entity_id"), "nationality", "customer_type", "risk", "document_check_status"), "entity_id", "left").select(
        "query_id", "tokens", "normalized", "sorted_key", fuzzy.phonetic_keys("tokens").alias("phonetic"), S.hashed_embedding(F.col("normalized")).alias("embedding"),
        F.make_date(born, (e % 12 + 1).cast("int"), (e % 28 + 1).cast("int")).alias("birth"), "nationality", F.when(k == 4, F.concat(F.lit(" id"), e.cast("string"))).alias("id_number"),
        F.col("customer_type").alias("query_type"), F.coalesce("risk", F.lit("medium")).alias("risk"), F.coalesce("document_check_status", F.lit("pass")).alias("document"))
    return written(queries, "queries"), corpus


@query("screen_batch")
def screen_batch(spark, d):
    """Flagship: respelled names screened against the whole watchlist; four retrievers, ratios, cosine, adjustments, the
    best name of an entity, ten best entities, and the route that score, customer risk and documents give."""
    queries, corpus = screening_tables(spark, d)
    stats = written(S.token_stats(corpus), "token-stats")
    best = S.ranked(S.scored(written(S.candidates(queries, corpus, stats), "candidates"), queries, corpus, stats))
    routed = best.join(queries.select("query_id", "risk", "document"), "query_id").withColumn("route", D.route(F.col("score"), F.col("risk"), F.col("document"), F.col("corroborated")))
    return routed.select("query_id", "rank", "entity_id", "name_id", F.array_join("methods", ",").alias("methods"), "score", "route.tier")


@query("evaluation_run")
def evaluation_run(spark, d):
    """Hybrid screening and the plain token set ratio, measured at every threshold over the seeded set of 220, 90 and 140 names.

    The set is drawn from all names; what bears a name that is asked for is a true match, whichever of its bearers it is."""
    names, corpus = watch_corpus(spark, d)
    stats = written(S.token_stats(corpus), "token-stats")
    year = (1950 + F.col("entity_id") % 45).cast("int")
    borne = names.groupBy("raw").agg(F.min(F.struct("name_id", "entity_id", year.alias("year"))).alias("first"), F.max(year).alias("last_year")).select("raw", "first.*", "last_year")
    asked = text.with_name(S.evaluation_set(borne), F.col("raw"))
    queries = written(asked.select(
        "query_id", "label", "true_entity", "true_name", "tokens", "normalized", "sorted_key", fuzzy.phonetic_keys("tokens").alias("phonetic"), S.hashed_embedding(F.col("normalized")).alias("embedding"),
        F.make_date("year", F.lit(1), F.lit(1)).alias("birth")), "evaluation-queries")
    found = written(S.candidates(queries, corpus, stats), "candidates")
    hybrid = S.ranked(S.scored(found, queries, corpus, stats), 1)
    plain = S.baseline(found.where(F.exists("methods", lambda m: m != "vector")), queries, corpus)

    def measured(best, method):
        top = best.select("query_id", F.col("entity_id").alias("top_entity"), F.col("score").alias("top_score"))
        bearers = names.select(F.col("raw").alias("true_name"), F.col("entity_id").alias("top_entity"), F.lit(True).alias("bears")).distinct()
        results = queries.select("query_id", "label", "true_entity", "true_name").join(top, "query_id", "left").join(bearers, ["true_name", "top_entity"], "left")
        results = results.withColumn("true_entity", F.when(F.col("bears"), F.col("top_entity")).otherwise(F.col("true_entity")))
        return D.confusion(results, D.thresholds_sweep()).withColumn("method", F.lit(method))

    return measured(hybrid, "hybrid").unionByName(measured(plain, "baseline"))
