"""The engine's queries over the driver tables, each beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import emotion, hashing, safety, text, transforms
from ..operators import aggregates, conversation, graph, index, ranges, rank, relational
from ..sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Queries never ask the clock.
AS_OF = "2024-01-31 00:00:00"
TERMS = ["the", "that", "tion", "ther", "with", "hein", "eran"]
QUERY_TERMS = ["ther", "eran", "anhe"]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is any."""
    def add(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLES[make.__name__] = sql
        return make
    return add


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_as_of = lambda: F.lit(AS_OF).cast("timestamp")

_TOKENS = rf"""
words AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos
          FROM (SELECT doc_id, regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+') AS l FROM documents)),
tok AS (SELECT doc_id, pos, lower(w) AS token FROM words WHERE regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*')),
kw AS (SELECT doc_id, token, count(*) AS freq, min(pos) AS first_pos FROM tok
       WHERE length(token) BETWEEN 3 AND 40 AND token NOT IN ({_list(text.STOPWORDS)}) GROUP BY doc_id, token),
ann AS (SELECT * FROM (SELECT *, 1.0 + 0.2 * least(freq - 1, 5) AS weight,
                       row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first_pos) AS rnk FROM kw) WHERE rnk <= 25)"""
_FNV_OF = lambda c: f"list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({c}) + 1), lambda spot: ascii({c}[spot])::HUGEINT)), lambda acc, nxt: (xor(acc, nxt) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_SIGNED = lambda h: f"(CASE WHEN {h} >= 9223372036854775808::HUGEINT THEN {h} - 18446744073709551616::HUGEINT ELSE {h} END)::BIGINT"
_PRINTS = rf"""{_TOKENS},
hashed AS (SELECT doc_id, token, {_FNV_OF('token')} AS h FROM ann WHERE rnk <= 15),
bits AS (SELECT doc_id, b, sum(CASE WHEN (h // (1::HUGEINT << b)) % 2 = 1 THEN 1 ELSE -1 END) AS v
         FROM hashed, (SELECT unnest(range(0, 64))::INTEGER AS b) GROUP BY doc_id, b),
voted AS (SELECT doc_id, sum(CASE WHEN v >= 0 THEN (1::HUGEINT << b) ELSE 0 END)::HUGEINT AS u FROM bits GROUP BY doc_id),
prints AS (SELECT d.doc_id, coalesce({_SIGNED('u')}, 0) AS simhash FROM documents d LEFT JOIN voted USING (doc_id))"""


def _docs(spark, d):
    return spread(table(spark, d, "documents"), "doc_id")


# -- index ----------------------------------------------------------------------------------------

@query(f"WITH {_TOKENS} SELECT token, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM tok GROUP BY token")
def tokens_freq(spark, d):
    return index.token_positions(_docs(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.countDistinct("doc_id").alias("docs"))


@query(f"WITH {_TOKENS}, l AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) SELECT count(*) AS docs, sum(n)::BIGINT AS tokens, round(avg(n), 4) AS avg_length, max(n) AS longest FROM l")
def doc_length_stats(spark, d):
    lengths = index.token_positions(_docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return lengths.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 4).alias("avg_length"), F.max("n").alias("longest"))


@query(f"WITH {_TOKENS}, t AS (SELECT token, count(*) AS df FROM kw GROUP BY token) SELECT token, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 4) AS idf FROM t, (SELECT count(*) AS n FROM documents)")
def term_df_idf(spark, d):
    docs = _docs(spark, d)
    total = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    df = index.document_frequency(index.token_counts(docs))
    return df.crossJoin(F.broadcast(total)).select("token", "df", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 4).alias("idf"))


@query(f"WITH {_TOKENS}, t AS (SELECT DISTINCT token FROM kw) SELECT token, {_SIGNED('h')} AS hash FROM (SELECT token, {_FNV_OF('token')} AS h FROM t)")
def fnv1a_tokens(spark, d):
    return index.token_counts(_docs(spark, d)).select("token").distinct().select("token", hashing.fnv1a(F.col("token")).alias("hash"))


@query(f"WITH {_PRINTS} SELECT doc_id, simhash FROM prints")
def simhash_docs(spark, d):
    return index.fingerprints(_docs(spark, d))


@query(f"WITH {_PRINTS}, x AS (SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.simhash, b.simhash))::BIGINT AS distance FROM prints a JOIN prints b ON a.doc_id < b.doc_id WHERE a.simhash <> 0 AND b.simhash <> 0) SELECT * FROM x WHERE distance <= 6")
def hamming_pairs(spark, d):
    return index.hamming_join(index.fingerprints(_docs(spark, d)), 6)


@query(f"WITH {_TOKENS} SELECT doc_id, token, freq, round(weight, 4) AS weight, rnk AS rank FROM ann")
def annotate_keywords(spark, d):
    return index.keywords(_docs(spark, d)).select("doc_id", "token", "freq", F.round("weight", 4).alias("weight"), F.col("rank").cast("long").alias("rank"))


_INTENT_SQL = ", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches(lower(text), $q${p}$q$)' for p in ps)} THEN '{n}' END" for n, ps in text.INTENTS.items())


@query(f"SELECT doc_id, unnest(list_filter([{_INTENT_SQL}], lambda x: x IS NOT NULL)) AS intent FROM documents")
def annotate_intents(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(text.intents(F.col("text"))).alias("intent"))


def _annotate_sql(more: str = "", agents: list[str] = ()) -> str:
    """The steps as SQL; ``more`` are rows of the last two."""
    known = f"token IN ({_list(agents)})" if agents else "false"
    usual = f"length(token) >= 3 AND token NOT IN ({_list(text.STOPWORDS)})"
    held = lambda step, weight, names: f"UNION ALL SELECT doc_id, t, {step}, 0, {weight} FROM documents, (SELECT unnest([{_list(names)}]) AS t) WHERE contains(lower(text), t)"
    return rf"""{_TOKENS.replace('rnk <= 25', 'rnk <= 50')},
tags AS (SELECT doc_id, lower(unnest(l)) AS token, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, regexp_extract_all(text, '#(\w+)', 1) AS l FROM documents)),
said AS (SELECT doc_id, lower(unnest(l)) AS token, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, regexp_extract_all(text, '(?m)(?:^|[\s,.:;!?])@(\w+)', 1) AS l FROM documents)),
every AS (
  SELECT doc_id, token, 1 AS step, place, 2.0 AS weight FROM tags WHERE {usual}
  UNION ALL SELECT doc_id, token, 2, place, CASE WHEN {known} THEN 2.5 ELSE 1.5 END FROM said WHERE {known} OR ({usual})
  {held(3, 2.0, index.TERMS)} {held(4, 2.5, agents) if agents else ''}
  UNION ALL SELECT doc_id, lower(trim(lang)), 5, 0, 1.5 FROM documents WHERE trim(lang) <> ''
  UNION ALL SELECT doc_id, unnest(list_filter([{_INTENT_SQL}], lambda x: x IS NOT NULL)), 6, 0, 1.0 FROM documents
  UNION ALL SELECT doc_id, token, 7, rnk, weight FROM ann {more}),
firsts AS (SELECT doc_id, token, min(step) AS step, arg_min(place, (step, place)) AS place, CASE WHEN min(step) <= 2 THEN coalesce(max(weight) FILTER (step = 2), arg_min(weight, (step, place))) ELSE arg_min(weight, (step, place)) END AS weight FROM every GROUP BY doc_id, token),
roomy AS (SELECT *, 25 - count(*) FILTER (step < 7) OVER (PARTITION BY doc_id) AS room, row_number() OVER (PARTITION BY doc_id, step ORDER BY place) AS nth FROM firsts),
annotated AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, step, place, token) AS n FROM roomy WHERE step <> 7 OR nth <= room) WHERE n <= 25)"""


_ANNOTATE = _annotate_sql()


@query(f"WITH {_ANNOTATE} SELECT doc_id, token, step, round(weight, 4) AS weight FROM annotated")
def annotate_documents(spark, d):
    return index.annotate(_docs(spark, d), author="lang").withColumn("weight", F.round("weight", 4))


@query(f"WITH {_TOKENS}, f AS (SELECT token, count(DISTINCT doc_id) AS df FROM ann GROUP BY token) SELECT doc_id, a.token, round(weight * least(ln((SELECT count(*) FROM documents)::DOUBLE / (1 + df)) + 1.0, 5.0), 3) AS weight FROM ann a JOIN f ON a.token = f.token")
def tfidf_weights(spark, d):
    docs = _docs(spark, d)
    return index.apply_tfidf(index.keywords(docs), docs.count()).select("doc_id", "token", "weight")


def _last(mark: str) -> str:
    return f"(CASE WHEN instr(c, '{mark}') > 0 THEN 301 - instr(reverse(c), '{mark}') ELSE 0 END)"


@query(f"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN trim(text, ' ')
  {' '.join(f"WHEN {_last(m)} - 1 > 150 THEN trim(left(c, {_last(m)}), ' ')" for m in '.!?')}
  WHEN {_last(' ')} - 1 > 150 THEN trim(left(c, {_last(' ')} - 1), ' ') || '...' ELSE trim(c, ' ') || '...' END AS summary
  FROM (SELECT doc_id, text, left(text, 300) AS c FROM documents)""")
def summaries(spark, d):
    return _docs(spark, d).select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("SELECT min(doc_id) AS doc_id, md5(lower(trim(text, ' '))) AS content_hash FROM documents GROUP BY 2")
def exact_dedup(spark, d):
    return index.exact_dedup(_docs(spark, d))


_ASPECTS = rf"""{_PRINTS},
named AS (SELECT doc_id, lower(trim(source, ' ')) AS s, lower(trim(lang, ' ')) AS a,
  coalesce(list_filter([{_INTENT_SQL}], lambda x: x IS NOT NULL)[1], 'none') AS i,
  coalesce({', '.join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in sorted(index.TERMS))}, 'general') AS p FROM documents),
found AS (SELECT doc_id, simhash AS sem_hash, {', '.join(f"{_SIGNED(f'h{c}')} AS {n}" for c, n in zip('saip', index.ASPECTS[1:]))}
  FROM prints JOIN (SELECT doc_id, {', '.join(f'{_FNV_OF(c)} AS h{c}' for c in 'saip')} FROM named) USING (doc_id))"""


@query(f"WITH {_ASPECTS} SELECT doc_id, sem_hash, source_hash, agent_hash, intent_hash, project_hash FROM found")
def aspect_hashes(spark, d):
    return index.aspects(_docs(spark, d)).select("doc_id", *index.ASPECTS)


@query(f"WITH {_ASPECTS}, t AS (SELECT sem_hash, min(doc_id) AS f FROM found GROUP BY ALL), k AS (SELECT sem_hash, source_hash, agent_hash, min(doc_id) AS g FROM found GROUP BY ALL) SELECT doc_id, CASE WHEN g < doc_id THEN 'likely_dup' WHEN f < doc_id THEN 'topic_seen' ELSE 'new' END AS status FROM found JOIN t USING (sem_hash) JOIN k USING (sem_hash, source_hash, agent_hash)")
def cascade_dedup(spark, d):
    return index.cascade(index.aspects(_docs(spark, d)))


_EQUAL = " + ".join(f"(x.{c} = y.{c})::INT" for c in index.ASPECTS)


@query(f"""WITH {_ASPECTS}, b AS (SELECT x.doc_id, coalesce(max({_EQUAL}), 0)::BIGINT AS best FROM found x LEFT JOIN found y ON y.doc_id < x.doc_id GROUP BY x.doc_id)
 SELECT doc_id, CASE WHEN best >= 3 THEN best ELSE 0 END AS best, CASE WHEN best >= 4 THEN 'skip' WHEN best >= 3 THEN 'merge' ELSE 'insert' END AS decision FROM b""")
def ingest_decision(spark, d):
    return index.ingest_decision(index.aspects(_docs(spark, d)))


@query(f"""WITH {_ASPECTS}, p AS (SELECT x.doc_id, ({_EQUAL})::BIGINT AS matches FROM found x JOIN found y ON x.doc_id <> y.doc_id), b AS (SELECT doc_id, count(*) AS n_links, max(matches) AS best FROM p WHERE matches >= 2 GROUP BY doc_id)
 SELECT f.doc_id, coalesce(n_links, 0) AS n_links, coalesce(best, 0) AS best, CASE WHEN best >= 5 THEN 2.2 WHEN best >= 4 THEN 1.7 WHEN best >= 3 THEN 1.3 ELSE 1.0 END AS boost FROM found f LEFT JOIN b ON f.doc_id = b.doc_id""")
def aspect_convergence(spark, d):
    found = index.convergence(index.aspects(_docs(spark, d)))
    return found.select("doc_id", "n_links", "best", rank.convergence(F.col("best")).alias("boost"))


# -- ranking --------------------------------------------------------------------------------------

_BM25 = f"""{_TOKENS}, len AS (SELECT doc_id, sum(freq)::DOUBLE AS length FROM kw GROUP BY doc_id),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(length) AS avg_length FROM len),
hits AS (SELECT * FROM kw WHERE token IN ({_list(QUERY_TERMS)})), df AS (SELECT token, count(*)::DOUBLE AS df FROM hits GROUP BY token),
bm AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * freq * 2.5 / (freq + 1.5 * (0.25 + 0.75 * length / avg_length))) AS bm25, count(*) AS matched, max(length) AS length
       FROM hits JOIN df USING (token) JOIN len USING (doc_id), corpus GROUP BY doc_id)"""


@query(f"WITH {_BM25} SELECT doc_id, round(bm25, 4) AS bm25, matched FROM bm ORDER BY round(bm25, 4) DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    found = rank.bm25(_docs(spark, d), QUERY_TERMS).select("doc_id", F.round("bm25", 4).alias("bm25"), "matched")
    return rank.topk(found, "bm25", "doc_id", 20)


@query(f"WITH {_BM25} SELECT doc_id, matched, round(0.15 + 0.85 * pow(matched / 3.0, 1.5), 4) AS coverage FROM bm")
def coverage_rank(spark, d):
    return rank.bm25(_docs(spark, d), QUERY_TERMS).select("doc_id", "matched", F.round(rank.coverage(F.col("matched"), len(QUERY_TERMS)), 4).alias("coverage"))


@query(f"WITH {_TOKENS}, l AS (SELECT doc_id, sum(freq) AS n FROM kw GROUP BY doc_id) SELECT doc_id, round(1 / (1 + ln(greatest(n, 1))) * 1 / (1 + 0.15 * ln(greatest(length(text), 1))), 6) AS norm FROM l JOIN documents USING (doc_id)")
def length_norm(spark, d):
    docs = _docs(spark, d)
    lengths = index.token_counts(docs).groupBy("doc_id").agg(F.sum("freq").alias("n"))
    return lengths.join(docs, "doc_id").select("doc_id", F.round(rank.length_norm(F.col("n"), F.length("text")), 6).alias("norm"))


@query("SELECT source, CASE WHEN contains(lower(source), 'src1') THEN 1.2 WHEN contains(lower(source), 'src2') THEN 0.8 ELSE 1.0 END AS weight, count(*) AS docs FROM documents GROUP BY ALL")
def source_authority(spark, d):
    weighed = _docs(spark, d).select("source", rank.authority(F.col("source"), {"src1": 1.2, "src2": 0.8}).alias("weight"))
    return weighed.groupBy("source", "weight").agg(F.count(F.lit(1)).alias("docs"))


@query(f"""WITH {_BM25}, s AS (SELECT doc_id, source, matched, round((0.6 * ln(1 + matched) + 0.4 * bm25) * (0.15 + 0.85 * pow(matched / 3.0, 1.5)) * (1 / (1 + ln(greatest(length, 1))) * 1 / (1 + 0.15 * ln(greatest(length(text), 1)))), 6) AS score
  FROM bm JOIN documents USING (doc_id)) SELECT doc_id, source, score, matched FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def rank_pipeline(spark, d):
    return rank.search(_docs(spark, d), QUERY_TERMS, limit=20)


_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9"


@query(f"SELECT event_id, round(1 + 0.2 * pow(2.0, -{_AGE} / 48.0), 6) AS neutral, round(1 + pow(2.0, -{_AGE} / 48.0), 6) AS recent, round(2 - pow(2.0, -{_AGE} / 48.0), 6) AS historical FROM events")
def temporal_boost(spark, d):
    age = rank.hours_between(_as_of(), F.col("ts"))
    return table(spark, d, "events").select("event_id", *[F.round(rank.temporal(age, i), 6).alias(i) for i in ("neutral", "recent", "historical")])


@query(f"SELECT event_type AS topic, round(sum(value * exp(-{_AGE} / 24.0)), 4) AS heat FROM events WHERE {_AGE} BETWEEN 0 AND 168 GROUP BY event_type")
def topic_heat(spark, d):
    return rank.topic_heat(table(spark, d, "events"), _as_of(), topic="event_type", weight="value", at="ts").withColumn("heat", F.round("heat", 4))


@query("SELECT user_id, round(1 + 0.3 * ln(1 + sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0.3 END)), 4) AS boost FROM events GROUP BY user_id")
def selection_boost(spark, d):
    return rank.selection_boost(table(spark, d, "events"), key="user_id", signal="event_type", weights={"purchase": 1.0, "click": 0.5}).withColumn("boost", F.round("boost", 4))


@query(f"SELECT user_id, round(greatest(0.2, 1 - sum(0.1 * exp(-({_AGE} / 24) / 60.0))), 4) AS penalty FROM events WHERE event_type = 'error' AND {_AGE} / 24 BETWEEN 0 AND 180 GROUP BY user_id")
def negation_penalty(spark, d):
    rejected = table(spark, d, "events").filter("event_type = 'error'")
    return rank.negation(rejected, _as_of(), key="user_id", at="ts").withColumn("penalty", F.round("penalty", 4))


@query(f"WITH {_TOKENS} SELECT doc_id, round(ln(1 + sum(weight)), 4) AS score, list_aggregate(list_sort(list(DISTINCT token)), 'string_agg', ',') AS matched FROM ann WHERE token IN ({_list(QUERY_TERMS)}) GROUP BY doc_id")
def annotation_recall(spark, d):
    return rank.recall(index.keywords(_docs(spark, d)), QUERY_TERMS).select("doc_id", F.round("score", 4).alias("score"), F.array_join("matched", ",").alias("matched"))


# -- text -----------------------------------------------------------------------------------------

_Q = lambda p: "$q$" + p + "$q$"


@query(rf"""WITH t AS (SELECT doc_id, text, trim(text, ' ') AS s, string_split(trim(text, ' '), chr(10)) AS lines, list_filter(regexp_split_to_array(lower(trim(text, ' ')), '\s+'), lambda w: w <> '') AS words FROM documents)
SELECT doc_id, CASE WHEN length(s) < 20 THEN 'too_short' WHEN regexp_matches(text, {_Q(text.BASE64)}) THEN 'base64' WHEN regexp_matches(text, '[\x00-\x08\x0e-\x1f]') THEN 'control'
 WHEN regexp_matches(text, {_Q(text.JSON_BLOB)}) THEN 'json' WHEN regexp_matches(text, {_Q(text.NOTEBOOK)}) AND length(text) - length(replace(text, '{{', '')) > 1 THEN 'notebook'
 WHEN regexp_matches(text, {_Q(text.LICENSE)}) THEN 'license' WHEN len(lines) >= 3 AND len(list_filter(lines, lambda x: regexp_matches(x, {_Q(text.IMPORT_LINE)}))) / len(lines) > 0.6 THEN 'imports'
 WHEN len(lines) >= 3 AND len(list_filter(lines, lambda x: regexp_matches(x, {_Q(text.CONFIG_LINE)}))) / len(lines) > 0.7 THEN 'config'
 WHEN len(words) >= 8 AND len(list_distinct(words)) / len(words) < 0.3 THEN 'repetitive'
 WHEN length(regexp_replace(text, '[^\p{{L}}\p{{N}}\s]', '', 'g')) / length(text) < 0.5 THEN 'symbols' END AS reason FROM t""")
def garbage_filter(spark, d):
    return _docs(spark, d).select("doc_id", text.garbage_reason(F.col("text")).alias("reason"))


def _emotion_sql(columns: str = "conv_id, turn") -> str:
    hits = lambda p: f"len(regexp_extract_all(low, $q${p}$q$))"

    def every(patterns):
        words, phrases = emotion.passes(patterns)
        return f"({' + '.join(map(hits, [words, *phrases]))})"

    modifier = f"greatest(0.5, least(2.0, 1.0 + {every(emotion.AMPLIFIERS)} * 0.1 - {every(emotion.DIMINISHERS)} * 0.1))::DOUBLE"
    two = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
    scores = ", ".join(f"{two(two(f'{every(p)} * {w}::DOUBLE / n * 100') + ' * ' + modifier)} AS {name.lower()}" for name, (w, p) in emotion.DIMENSIONS.items())
    return rf"SELECT {columns}, {scores} FROM (SELECT {columns}, regexp_replace(lower(text), '{emotion.FOREIGN}', 'z', 'g') AS low, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS n FROM conversations) WHERE n > 0"


@query(_emotion_sql())
def emotion_scores(spark, d):
    scores = emotion.emotion_scores(F.col("text"))
    rows = table(spark, d, "conversations").filter(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) > 0)
    return rows.select("conv_id", "turn", *[c.alias(n.lower()) for n, c in scores.items()])


@query(r"""SELECT doc_id, length(text) AS chars, len(w) AS words, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p, ' ') <> '')) AS paragraphs,
 len(list_distinct(list_transform(w, lambda x: lower(x)))) AS unique_words, length(text) // 4 AS tokens_estimate
 FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)""")
def text_info(spark, d):
    return _docs(spark, d).select("doc_id", *[c.alias(n) for n, c in text.text_info(F.col("text")).items()])


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(text, {_Q(transforms.EMAIL)}), ',') AS emails, array_to_string(regexp_extract_all(text, {_Q(transforms.URL)}), ',') AS urls, array_to_string(regexp_extract_all(text, {_Q(transforms.IP)}), ',') AS ips, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents")
def extract_patterns(spark, d):
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    return _docs(spark, d).select("doc_id", *[F.array_join(found(p), ",").alias(n) for n, p in (("emails", transforms.EMAIL), ("urls", transforms.URL), ("ips", transforms.IP))], F.size(found("[0-9]+")).cast("long").alias("numbers"))


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, reverse(p_name) AS back, replace(lower(p_type), ' ', '_') AS snake, replace(lower(p_type), ' ', '-') AS kebab, repeat(p_brand, 2) AS twice, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS rot FROM part")
def text_case(spark, d):
    c = lambda name, chain: transforms.apply(F.col(name), chain)
    return table(spark, d, "part").select("p_partkey", c("p_name", "upper").alias("up"), c("p_type", "lower").alias("low"), c("p_name", "reverse-text").alias("back"), c("p_type", "lower,snake").alias("snake"), c("p_type", "lower,kebab").alias("kebab"), c("p_brand", "repeat").alias("twice"), c("p_name", "rot13").alias("rot"))


@query("SELECT page_id, md5(url) AS md5, sha1(url) AS sha1, sha256(url) AS sha256, base64(encode(url)) AS b64, lower(hex(encode(url))) AS hex, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM pages")
def text_encode(spark, d):
    c = lambda chain: transforms.apply(F.col("url"), chain)
    return table(spark, d, "pages").select("page_id", c("md5").alias("md5"), c("sha1").alias("sha1"), c("sha256").alias("sha256"), c("base64-encode").alias("b64"), c("hex-encode").alias("hex"), c("html-encode").alias("html"))


@query("""SELECT doc_id, md5(array_to_string(list_sort(l), chr(10))) AS sorted, md5(array_to_string(list_reverse(l), chr(10))) AS reversed, len(l)::VARCHAR AS lines, md5(array_to_string(list_slice(l, 1, 3), chr(10))) AS head,
 md5(array_to_string(list_filter(l, lambda x: contains(x, 'the')), chr(10))) AS grep FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def text_lines(spark, d):
    c = lambda chain: F.md5(transforms.apply(F.col("text"), chain).cast("binary"))
    return _docs(spark, d).select("doc_id", c("sort").alias("sorted"), c("reverse").alias("reversed"), transforms.apply(F.col("text"), "lines-count").alias("lines"), c("head:3").alias("head"), c("grep:the").alias("grep"))


@query("SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 57) || '...' END AS short, regexp_replace(text, '[0-9]', '', 'g') = text AS digitless, length(regexp_replace(text, '\\s+', '', 'g')) AS solid FROM documents")
def text_format(spark, d):
    c = lambda chain: transforms.apply(F.col("text"), chain)
    return _docs(spark, d).select("doc_id", c("truncate:60").alias("short"), (F.regexp_replace("text", "[0-9]", "") == F.col("text")).alias("digitless"), F.length(c("remove-whitespace")).cast("long").alias("solid"))


@query("SELECT event_id, array_to_string(list_sort(json_keys(props)), chr(10)) AS keys, (props->>'k')::BIGINT AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", transforms.apply(F.col("props"), "json-keys").alias("keys"), F.get_json_object("props", "$.k").cast("long").alias("k"))


# -- safety ---------------------------------------------------------------------------------------

@query(rf"""SELECT doc_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][level + 1] AS severity, level = 0 AS valid FROM (SELECT doc_id, greatest(CASE WHEN length(text) > 10000 THEN 2 ELSE 0 END,
 CASE WHEN regexp_matches(lower(text), {_Q(safety.INJECTION)}) THEN 3 ELSE 0 END, CASE WHEN regexp_matches(text, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]|[\x{{202A}}-\x{{202E}}]|[\x{{0300}}-\x{{036F}}]{{3,}}') THEN 2 ELSE 0 END,
 CASE WHEN length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / greatest(length(text), 1) > 0.5 THEN 1 ELSE 0 END) AS level FROM documents)""")
def input_validation(spark, d):
    v = safety.validate(F.col("text"))
    return _docs(spark, d).select("doc_id", v["severity"].alias("severity"), v["valid"].alias("valid"))


_HITS = {c: " + ".join(f"(contains(lower(text), '{p}'))::INT" for p in ps) for c, ps in safety.watched().items()}


@query(f"""SELECT conv_id, turn, ({' + '.join(_HITS.values())})::BIGINT AS violations, concat_ws(',', {', '.join(f"CASE WHEN {h} > 0 THEN '{c}' END" for c, h in _HITS.items())}) AS categories,
 CASE WHEN {' + '.join(_HITS[c] for c in safety.SEVERE)} > 0 THEN 0.8 WHEN {_HITS['DECEPTION']} > 0 THEN 0.6 ELSE least(({' + '.join(_HITS.values())}) * 0.15, 0.5) END AS risk FROM conversations""")
def boundary_risk(spark, d):
    r = safety.boundary_risk(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in r.items()])


def _value_sql(good, bad):
    n = lambda words: " + ".join(f"(contains(lower(text), '{w}'))::INT" for w in words)
    return f"round(greatest(0.0, least(1.0, 0.5 + ({n(good)}) * 0.1 - ({n(bad)}) * 0.15)), 4)"


@query(f"SELECT conv_id, turn, {', '.join(f'{_value_sql(*w)} AS {v.lower()}' for v, w in safety.VALUES.items())} FROM conversations")
def value_alignment(spark, d):
    scores = safety.value_scores(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", *[F.round(c, 4).alias(v.lower()) for v, c in scores.items()])


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_LONG = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) > 3)"


@query(rf"""WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 100),
 size AS (SELECT conv_id, avg(length(text)) AS avg_chars, avg(len({_WORDS})) AS avg_words FROM last GROUP BY conv_id),
 w AS (SELECT conv_id, word, count(*) AS c FROM (SELECT conv_id, unnest({_LONG}) AS word FROM last) GROUP BY ALL),
 top AS (SELECT conv_id, list(word) AS words FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, word) AS r FROM w) WHERE r <= 20 GROUP BY conv_id),
 m AS (SELECT c.conv_id, c.turn, abs(length(text) - avg_chars) / greatest(avg_chars, 1) AS a, abs(len({_WORDS}) - avg_words) / greatest(avg_words, 1) AS b,
   len(list_intersect(list_distinct({_LONG}), coalesce(words, []))) / greatest(len(coalesce(words, [])), 1) AS o FROM conversations c JOIN size s ON c.conv_id = s.conv_id LEFT JOIN top t ON c.conv_id = t.conv_id)
 SELECT conv_id, turn, round(least(1.0, CASE WHEN a > 2 THEN least(a / 5, 0.3) ELSE 0 END + CASE WHEN b > 2 THEN least(b / 5, 0.3) ELSE 0 END + CASE WHEN o < 0.1 THEN 0.4 ELSE 0 END), 4) AS drift FROM m""")
def behavior_drift(spark, d):
    rows = table(spark, d, "conversations")
    base = conversation.baseline(rows, agent="conv_id", order="turn", text="text")
    return conversation.drift(rows, base, agent="conv_id", text="text").select("conv_id", "turn", F.round("drift", 4).alias("drift"))


# -- aggregates -----------------------------------------------------------------------------------

def _profile_sql(name, columns):
    rows = []
    for c, numeric in columns:
        mean = f"round(avg({c}), 4)" if numeric else "NULL::DOUBLE"
        rows.append(f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, round(1 - count({c}) / count(*), 4) AS null_share, {mean} AS mean FROM {name}")
    return " UNION ALL ".join(rows)


@query(_profile_sql("orders", [("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False)]))
def column_profile(spark, d):
    return aggregates.column_profile(table(spark, d, "orders")).select("column", "non_null", "distinct_values", F.round("null_share", 4).alias("null_share"), F.round("mean", 4).alias("mean"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def group_counts(spark, d):
    return aggregates.group_counts(_docs(spark, d), "source", "lang")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS purchases FROM events GROUP BY user_id")
def conditional_counts(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(kind == "error").alias("errors"), F.round(F.coalesce(F.sum(F.when(kind == "purchase", F.col("value"))), F.lit(0.0)), 4).alias("purchases"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (i = least(n // 2, n - 1)) AS p50, max(value) FILTER (i = least(floor(n * 0.95)::BIGINT, n - 1)) AS p95, max(n) AS n FROM r GROUP BY event_type")
def latency_percentiles(spark, d):
    return ranges.percentiles(table(spark, d, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95})


def _usage(spark, d):
    lines = table(spark, d, "lineitem")
    model = F.element_at(F.array(*map(F.lit, ["large", "medium", "small", "other"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return lines.select((F.col("l_suppkey") % 10).cast("string").alias("agent"), model.alias("model"), F.col("l_quantity").alias("input_tokens"), F.col("l_extendedprice").alias("output_tokens"), F.col("l_shipdate").alias("at"))


_USAGE = """u AS (SELECT (l_suppkey % 10)::VARCHAR AS agent, ['large', 'medium', 'small', 'other'][l_linenumber % 4 + 1] AS model, l_quantity AS i, l_extendedprice AS o, l_shipdate AS shipped FROM lineitem),
 c AS (SELECT *, CASE model WHEN 'large' THEN i / 1e6 * 15 + o / 1e6 * 75 WHEN 'small' THEN i / 1e6 * 0.8 + o / 1e6 * 4 ELSE i / 1e6 * 3 + o / 1e6 * 15 END AS cost FROM u)"""


@query(f"WITH {_USAGE} SELECT CASE WHEN grouping(agent) = 1 AND grouping(model) = 1 THEN 'total' WHEN grouping(model) = 1 THEN 'agent' ELSE 'model' END AS level, coalesce(agent, model, '*') AS name, count(*) AS calls, round(sum(i), 2) AS input_tokens, round(sum(o), 2) AS output_tokens, round(sum(cost), 4) AS cost FROM c GROUP BY GROUPING SETS ((), (agent), (model))")
def usage_rollup(spark, d):
    r = aggregates.usage_rollup(_usage(spark, d))
    return r.select("level", "name", "calls", F.round("input_tokens", 2).alias("input_tokens"), F.round("output_tokens", 2).alias("output_tokens"), F.round("cost", 4).alias("cost"))


@query(f"WITH {_USAGE} SELECT model, round(sum(cost), 4) AS cost, round(sum(cost) / count(*), 8) AS per_call FROM c GROUP BY model")
def cost_by_model(spark, d):
    priced = _usage(spark, d).withColumn("cost", aggregates.cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))
    return priced.groupBy("model").agg(F.round(F.sum("cost"), 4).alias("cost"), F.round(F.sum("cost") / F.count(F.lit(1)), 8).alias("per_call"))


@query(f"WITH {_USAGE} SELECT strftime(shipped, '%Y-%m') AS month, round(sum(cost), 4) AS spent, CASE WHEN sum(cost) / 30 < 0.8 THEN 'on_track' WHEN sum(cost) / 30 <= 1 THEN 'warning' ELSE 'over' END AS status FROM c GROUP BY 1")
def budget_status(spark, d):
    return aggregates.budget_status(_usage(spark, d), "at", 30.0).select("month", F.round("spent", 4).alias("spent"), "status")


@query("SELECT user_id AS agent, count(*) AS actions, max(ts) AS last_active, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id")
def agent_rollup(spark, d):
    return aggregates.agent_rollup(table(spark, d, "events"), agent="user_id", action="event_type", at="ts")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_users(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT 'o_totalprice' AS dimension, round(min(o_totalprice), 4) AS least, round(max(o_totalprice), 4) AS greatest, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS n FROM orders UNION ALL SELECT 'o_custkey', min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE, round(avg(o_custkey), 4), count(o_custkey) FROM orders")
def score_spread(spark, d):
    r = aggregates.spread(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])
    return r.select("dimension", *[F.round(c, 4).alias(c) for c in ("least", "greatest", "mean")], "n")


@query(f"SELECT key, round(gap, 4) AS gap_hours, round(least(1.0, gap / 168), 4) AS decay, CASE WHEN gap > 24 THEN 'decaying' WHEN gap > 4 THEN 'aging' ELSE 'fresh' END AS state FROM (SELECT user_id AS key, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 3.6e9 AS gap FROM events GROUP BY user_id)")
def freshness(spark, d):
    r = aggregates.freshness(table(spark, d, "events"), _as_of(), key="user_id", at="ts")
    return r.select("key", F.round("gap_hours", 4).alias("gap_hours"), F.round("decay", 4).alias("decay"), "state")


@query("SELECT request, count(*) AS votes, round(avg(approve::INT), 4) AS approve_share, CASE WHEN count(*) < 2 THEN 'PENDING' WHEN avg(approve::INT) >= 0.67 THEN 'APPROVED' WHEN 1 - avg(approve::INT) >= 0.67 THEN 'REJECTED' ELSE 'PENDING' END AS status FROM (SELECT user_id AS request, value > 50 AS approve FROM events) GROUP BY request")
def quorum_status(spark, d):
    r = aggregates.quorum(table(spark, d, "events").select(F.col("user_id").alias("request"), (F.col("value") > 50).cast("int").alias("approve")))
    return r.withColumn("approve_share", F.round("approve_share", 4))


# -- relational -----------------------------------------------------------------------------------

@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def browse_page(spark, d):
    return relational.browse(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", (-F.col("o_totalprice")).alias("down")), ["down", "o_orderkey"], where=F.col("o_orderstatus") == "F", limit=25, offset=50).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_rows(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


_SEARCH = {"customer": ("c_custkey", ["c_name", "c_mktsegment"]), "supplier": ("s_suppkey", ["s_name"]), "part": ("p_partkey", ["p_name", "p_brand", "p_type"])}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {k}::VARCHAR AS key, {c} AS value FROM {t} WHERE contains(lower({c}), '12')" for t, (k, cs) in _SEARCH.items() for c in cs))
def cross_table_search(spark, d):
    return relational.search_tables({t: (table(spark, d, t).select(k, *cs), k) for t, (k, cs) in _SEARCH.items()}, "12")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'eron the')")
def like_filter(spark, d):
    return _docs(spark, d).filter(relational.like(F.col("text"), "ERON the")).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, d):
    large = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(large, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey OR o_orderkey = c_custkey)")
def anti_orphans(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return graph.orphans(nodes, table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id")))


@query("WITH a AS (SELECT doc_id AS id, md5(text) AS v FROM documents), b AS (SELECT item_id + 20 AS id, md5(text) AS v FROM benchmark) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'deleted' WHEN a.v <> b.v THEN 'modified' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.id = b.id")
def outer_compare(spark, d):
    a = _docs(spark, d).select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("v"))
    b = table(spark, d, "benchmark").select((F.col("item_id") + 20).alias("id"), F.md5(F.col("text").cast("binary")).alias("v"))
    return relational.compare(a, b, "id", "v")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 300000000 WHERE a.event_type = 'error'")
def band_join_5min(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'")
    a, b = e.select(F.col("event_id").alias("a"), F.col("ts").alias("at"), "event_type"), e.select(F.col("event_id").alias("b"), F.col("ts").alias("bt"), "event_type")
    return relational.band_join(a, b, at_left="at", at_right="bt", seconds=300, keys=["event_type"]).filter("a < b").select("a", "b")


@query("SELECT DISTINCT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey OR o_orderkey = c_custkey")
def or_join(spark, d):
    r = relational.either_join(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")
    return r.select("c_custkey", "o_orderkey").distinct()


@query("SELECT e.event_id, c.c_custkey FROM events e JOIN customer c ON 'user:' || (e.props->>'k') = 'user:' || c.c_custkey")
def computed_key_join(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("user:"), F.get_json_object("props", "$.k")).alias("key"))
    return e.join(table(spark, d, "customer").select("c_custkey", F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key")), "key").select("event_id", "c_custkey")


@query("SELECT user_id, round(max(score), 4) AS score FROM (SELECT user_id, max(value) AS score FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, avg(value) * 2 FROM events WHERE event_type = 'view' GROUP BY 1) GROUP BY user_id")
def set_union_max(spark, d):
    e = table(spark, d, "events")
    one = e.filter("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("score"))
    two = e.filter("event_type = 'view'").groupBy("user_id").agg((F.avg("value") * 2).alias("score"))
    return relational.keep_best([one, two], ["user_id"], "score").withColumn("score", F.round("score", 4))


@query("SELECT text FROM benchmark EXCEPT SELECT text FROM documents")
def set_difference(spark, d):
    return table(spark, d, "benchmark").select("text").subtract(_docs(spark, d).select("text"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


# -- graph ----------------------------------------------------------------------------------------

_LINKS = f"""{_TOKENS}, linking AS (SELECT doc_id, token FROM ann),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS overlap FROM linking a JOIN linking b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 3),
 links AS (SELECT x AS source_id, y AS target_id, overlap, least(1.0, 0.3 + 0.1 * overlap) AS strength FROM pairs UNION ALL SELECT y, x, overlap, least(1.0, 0.3 + 0.1 * overlap) FROM pairs)"""


@query(f"WITH {_LINKS} SELECT source_id, target_id, overlap, round(strength, 4) AS strength FROM links")
def shared_token_links(spark, d):
    return graph.shared_token_links(index.keywords(_docs(spark, d)))


_ORDER_LINKS = "links AS (SELECT DISTINCT l_suppkey AS source_id, 100000 + l_partkey % 500 AS target_id, 0.3 + 0.1 * (l_partkey % 7) AS strength FROM lineitem UNION SELECT DISTINCT 100000 + l_partkey % 500, l_suppkey, 0.3 + 0.1 * (l_partkey % 7) FROM lineitem), best AS (SELECT source_id, target_id, max(strength) AS strength FROM links GROUP BY ALL)"


def _order_links(spark, d):
    """A bipartite graph of suppliers and part groups, in both directions, each edge at its best strength."""
    rows = table(spark, d, "lineitem")
    one = rows.select(F.col("l_suppkey").alias("source_id"), (100000 + F.col("l_partkey") % 500).alias("target_id"), (0.3 + 0.1 * (F.col("l_partkey") % 7)).alias("strength"))
    both = one.unionByName(one.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "strength"))
    return both.groupBy("source_id", "target_id").agg(F.max("strength").alias("strength"))


@query(f"""WITH {_ORDER_LINKS}, steps AS (SELECT source_id, target_id AS neighbor, 1 AS hops, round(strength, 9) AS strength FROM best UNION ALL SELECT a.source_id, b.target_id, 2, round(a.strength * b.strength, 9) FROM best a JOIN best b ON a.target_id = b.source_id WHERE a.source_id <> b.target_id),
 m AS (SELECT source_id, neighbor, min(hops) AS hops, arg_max(strength, (-hops, strength)) AS strength FROM steps GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY hops, strength DESC, neighbor) AS rank FROM m) SELECT source_id, neighbor, hops, round(strength, 4) AS strength, rank FROM r WHERE rank <= 20""")
def top_neighbors(spark, d):
    links = _order_links(spark, d)
    r = graph.top_neighbors(links.withColumn("strength", F.round("strength", 9)))
    return r.select("source_id", "neighbor", F.col("hops").cast("int").alias("hops"), F.round("strength", 4).alias("strength"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_ORDER_LINKS}, one AS (SELECT DISTINCT target_id AS node FROM best WHERE source_id = 1), two AS (SELECT DISTINCT target_id AS node FROM best JOIN one ON source_id = node) SELECT node, min(hop) AS hop FROM (SELECT 1::BIGINT AS node, 0 AS hop UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY node")
def khop_subgraph(spark, d):
    return graph.khop(_order_links(spark, d), spark.createDataFrame([(1,)], "node long"), 2)


@query(f"SELECT user_id AS source_id, user_id % 7 AS target_id, round(sum(value - 50), 4) AS delta FROM events WHERE event_type = 'click' AND (ts + INTERVAL 10 DAY) > TIMESTAMP '{AS_OF}' GROUP BY ALL HAVING round(sum(value - 50), 9) <> 0")
def edge_overrides(spark, d):
    rows = table(spark, d, "events").filter("event_type = 'click'").select(F.col("user_id").alias("source_id"), (F.col("user_id") % 7).alias("target_id"), (F.col("value") - 50).alias("delta"), F.expr("ts + INTERVAL 10 DAY").alias("expires_at"))
    return graph.edge_overrides(rows, _as_of()).withColumn("delta", F.round("delta", 4))


@query(f"WITH {_LINKS}, g AS (SELECT source_id, count(*) AS n FROM links GROUP BY 1) SELECT coalesce(sum(n), 0)::BIGINT AS edges, count(*) AS nodes, max(n) AS max_degree, round(avg(n), 4) AS mean_degree FROM g")
def graph_stats(spark, d):
    return graph.shared_token_stats(index.keywords(_docs(spark, d))).withColumn("mean_degree", F.round("mean_degree", 4))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS rejections, CASE WHEN count(*) FILTER (event_type = 'error') >= 10 THEN 'once_thought' WHEN count(*) FILTER (event_type = 'error') >= 5 AND NOT bool_or(event_type = 'purchase' AND value > 60) THEN 'sub_hidden' WHEN count(*) FILTER (event_type = 'error') >= 3 THEN 'soft_suppressed' ELSE 'active' END AS state FROM events GROUP BY user_id")
def link_state(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("rejections"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("explored"))
    return g.select("user_id", "rejections", graph.link_state(F.col("rejections"), F.col("explored")).alias("state"))


@query(f"WITH {_TOKENS}, e AS (SELECT doc_id, token FROM ann WHERE rnk <= 5) SELECT a.token AS a, b.token AS b, count(*) AS n FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.token < b.token GROUP BY ALL")
def related_topics(spark, d):
    entries = index.keywords(_docs(spark, d), 5).groupBy("doc_id").agg(F.collect_list("token").alias("topics"))
    return graph.cooccurrence(entries, "doc_id", "topics")


@query()
def ppr_scores(spark, d):
    return graph.pagerank(_order_links(spark, d), [1, 2, 3], sweeps=50, epsilon=1e-4).withColumn("score", F.round("score", 6))


@query()
def diversity_sample(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.col("p_retailprice").alias("complexity"))
    return graph.diversity_sample(nodes, 50)


# -- conversations --------------------------------------------------------------------------------

_MESSAGES = "m AS (SELECT event_id AS key, 'user_' || (user_id % 23) AS sender, 'I vote for ' || event_type || ' @user_' || (user_id % 20) || chr(10) || 'Finding: event ' || event_id || ' of kind ' || event_type || CASE WHEN event_type = 'error' THEN chr(10) || 'I was not mentioned' ELSE '' END AS text FROM events)"


def _messages(spark, d):
    body = F.concat(F.lit("I vote for "), "event_type", F.lit(" @user_"), F.col("user_id") % 20, F.lit("\nFinding: event "), "event_id", F.lit(" of kind "), "event_type", F.when(F.col("event_type") == "error", "\nI was not mentioned").otherwise(""))
    return table(spark, d, "events").select(F.col("event_id").alias("key"), F.concat(F.lit("user_"), F.col("user_id") % 23).alias("sender"), body.alias("text"))


_KEYS = rf"list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')), lambda w: length(w) > 2 AND w NOT IN ({_list(text.MESSAGE_STOPWORDS)}))"


@query(f"""WITH w AS (SELECT conv_id, turn, {_KEYS} AS k FROM conversations), p AS (SELECT a.conv_id, a.turn, CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0.0 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) END AS j
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM w) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM w) b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 10 AND a.n - 1),
 s AS (SELECT conv_id, turn, max(j) AS j FROM p GROUP BY ALL) SELECT c.conv_id, c.turn, round(coalesce(j, 0.0), 4) AS similarity, coalesce(j, 0.0) >= 0.7 AS is_echo FROM conversations c LEFT JOIN s ON c.conv_id = s.conv_id AND c.turn = s.turn""")
def echo_jaccard(spark, d):
    r = conversation.echoes(table(spark, d, "conversations"), ["conv_id"], ["turn"])
    return r.select("conv_id", "turn", F.round("similarity", 4).alias("similarity"), "is_echo")


@query(f"""WITH w AS (SELECT conv_id, turn, {_KEYS} AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
 b AS (SELECT a.conv_id, a.turn, any_value(a.k) AS k, flatten(list(b.k)) AS seen FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 20 AND a.n - 1 GROUP BY ALL),
 f AS (SELECT w.conv_id, w.turn, w.k, coalesce(seen, []) AS seen, list_filter(w.k, lambda x: NOT list_contains(coalesce(seen, []), x)) AS fresh FROM w LEFT JOIN b ON w.conv_id = b.conv_id AND w.turn = b.turn)
 SELECT conv_id, turn, round(CASE WHEN len(seen) = 0 OR len(k) = 0 THEN 1.0 ELSE len(fresh) / len(k) END, 4) AS novelty, len(fresh) AS new_words FROM f""".replace("GROUP BY ALL),\n f", "GROUP BY a.conv_id, a.turn),\n f"))
def novelty(spark, d):
    r = conversation.novelty(table(spark, d, "conversations"), ["conv_id"], ["turn"])
    return r.select("conv_id", "turn", F.round("novelty", 4).alias("novelty"), "new_words")


@query("WITH p AS (SELECT event_type AS query, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events), c AS (SELECT query, following, count(*) AS n FROM p WHERE following IS NOT NULL GROUP BY ALL) SELECT query, following, n FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, following) AS r FROM c) WHERE r = 1")
def next_query_bigram(spark, d):
    return conversation.next_query(table(spark, d, "events"), user="user_id", query="event_type", order=["ts", "event_id"])


_MENTION = f"{_MESSAGES}, x AS (SELECT key, sender AS mentioner, unnest(regexp_extract_all(lower(text), '@(\\w+)', 1)) AS mentioned FROM m)"


@query(f"WITH {_MENTION}, o AS (SELECT key, sender, row_number() OVER (ORDER BY key) AS n FROM m) SELECT x.key, x.mentioner, x.mentioned, EXISTS (SELECT 1 FROM o b WHERE b.n BETWEEN a.n + 1 AND a.n + 10 AND b.sender = x.mentioned) AS acknowledged FROM x JOIN o a ON a.key = x.key")
def ack_within_10(spark, d):
    return conversation.acknowledged(_messages(spark, d), key="key", sender="sender", text="text")


@query(f"WITH {_MENTION} SELECT mentioner, mentioned, count(*) AS n FROM x GROUP BY ALL")
def mention_graph(spark, d):
    return conversation.mentions(_messages(spark, d), key="key", sender="sender", text="text").groupBy("mentioner", "mentioned").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MESSAGES}, v AS (SELECT sender AS voter, regexp_extract(lower(text), 'i\\s+vote\\s+(?:for\\s+)?(\\w+)', 1) AS choice, key FROM m), l AS (SELECT voter, arg_max(choice, key) AS choice FROM v GROUP BY voter) SELECT choice, count(*) AS votes FROM l GROUP BY choice")
def vote_tally(spark, d):
    return conversation.tally(conversation.votes(_messages(spark, d), key="key", sender="sender", text="text"))


@query(f"WITH {_MENTION}, f AS (SELECT mentioned, min(key) AS k FROM x GROUP BY 1) SELECT m.key, m.sender AS claimant, coalesce(f.k < m.key, false) AS contradicted FROM m LEFT JOIN f ON f.mentioned = m.sender WHERE contains(lower(text), 'was not mentioned')")
def claim_audit(spark, d):
    messages = _messages(spark, d)
    found = conversation.claims(messages, key="key", sender="sender", text="text")
    return conversation.audit_denials(found, conversation.mentions(messages, key="key", sender="sender", text="text"))


@query(f"WITH {_MESSAGES} SELECT key, 'FINDING' AS category, trim(regexp_extract(text, 'Finding:[ \\t]*([^\\n]+)', 1), ' ') AS content FROM m")
def knowledge_extract(spark, d):
    return conversation.knowledge(_messages(spark, d), key="key", text="text")


@query("WITH t AS (SELECT conv_id, turn, turn - min(turn) OVER (PARTITION BY conv_id) AS depth, role FROM conversations) SELECT conv_id, count(*) AS messages, count(DISTINCT role) AS participants, max(depth)::BIGINT AS depth, max(depth) >= 3 AND count(*) >= 5 AND count(DISTINCT role) >= 2 AS significant FROM t GROUP BY conv_id")
def thread_summary(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 100000 + F.col("turn")).alias("id"), (F.col("conv_id") * 100000 + F.col("turn") - 1).alias("parent_id"), F.col("role").alias("sender"))
    found = conversation.thread_summary(conversation.threads(rows), rows)
    return found.select(F.expr("root div 100000").alias("conv_id"), "messages", "participants", "depth", "significant")


@query()
def feedback_loops(spark, d):
    seen = table(spark, d, "events")
    return graph.feedback_loops(seen.select((F.col("user_id") % 6).cast("string").alias("mentioner"), (F.col("event_id") % 7).cast("string").alias("mentioned")))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def top_n_per_group(spark, d):
    ranked = table(spark, d, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    return ranked.filter("r <= 3").select("user_id", "event_id", "value")


@query("SELECT lang, source, doc_id, used FROM (SELECT *, sum(length(text)) OVER (PARTITION BY lang, source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 20000")
def context_budget(spark, d):
    rows = _docs(spark, d).withColumn("n", F.length("text"))
    return conversation.budget_prefix(rows, ["lang", "source"], ["doc_id"], "n", 20000).select("lang", "source", "doc_id", F.col("used").cast("long").alias("used"))


@query("SELECT source, doc_id, CASE WHEN p < 0.3 THEN 'full' WHEN p < 0.7 THEN 'brief' ELSE 'mention' END AS tier FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / count(*) OVER (PARTITION BY source) AS p FROM documents)")
def tier_pack(spark, d):
    return conversation.tiers(_docs(spark, d), ["source"], ["doc_id"]).select("source", "doc_id", "tier")


@query()
def rate_limit_fold(spark, d):
    return conversation.rate_limit(table(spark, d, "events"), "event_type", "ts", "event_id", most=5, seconds=3600)


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
 h AS (SELECT conv_id, turn, n, sha256(coalesce(text, '')) AS link FROM c WHERE n = 1 UNION ALL SELECT c.conv_id, c.turn, c.n, sha256(h.link || coalesce(c.text, '')) FROM h JOIN c ON c.conv_id = h.conv_id AND c.n = h.n + 1) SELECT conv_id, turn, link FROM h""")
def hash_chain(spark, d):
    return conversation.hash_chain(table(spark, d, "conversations"), ["conv_id"], "turn", "text")


# -- streams and states ---------------------------------------------------------------------------

@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS "begin", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    from ..streaming import events

    r = events.sessions(table(spark, d, "events"))
    return r.select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_type AS topic, date_trunc('day', ts)::TIMESTAMP AS \"begin\", round(sum(value), 4) AS weight, count(*) AS n FROM events GROUP BY 1, 2")
def heat_windows(spark, d):
    from ..streaming import events

    r = events.heat(table(spark, d, "events"))
    return r.select("topic", F.col("begin").cast("timestamp_ntz").alias("begin"), F.round("weight", 4).alias("weight"), "n")


@query(" UNION ALL ".join(f"SELECT '{t}' AS segment, count(*) AS rows, max({k})::BIGINT AS last, sha256('{t}:' || count(*) || ':' || coalesce(max({k}), 0)) AS checksum FROM {t}" for t, k in (("documents", "doc_id"), ("events", "event_id"), ("orders", "o_orderkey"))))
def segment_checksum(spark, d):
    from ..operators import sync

    return sync.segment_checksum({t: (table(spark, d, t), k) for t, k in (("documents", "doc_id"), ("events", "event_id"), ("orders", "o_orderkey"))})


@query("WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def manifest_diff(spark, d):
    """Two states of the documents: rows and texts differ by rules on the id, which make the states."""
    from ..operators import sync

    docs = _docs(spark, d)
    old = sync.manifest(docs.filter("doc_id % 7 <> 0"), "doc_id", "text")
    new = sync.manifest(docs.filter("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), "doc_id", "text")
    return sync.manifest_diff(old, new, "doc_id")


@query("SELECT * FROM (VALUES ('benchmark', 0, 'item_id', 'bigint'), ('benchmark', 1, 'text', 'string'), ('labels', 0, 'doc_id', 'bigint'), ('labels', 1, 'quality', 'int'), ('labels', 2, 'toxic', 'int')) t(\"table\", position, \"column\", type)")
def schema_columns(spark, d):
    from ..operators import sync

    return sync.schema_columns(spark, {t: table(spark, d, t) for t in ("benchmark", "labels")}).drop("nullable")


@query("SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value, max(ts) AS updated FROM events GROUP BY user_id")
def memory_latest(spark, d):
    best = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return best.select("key", F.col("m.event_type").alias("value"), F.col("m.ts").alias("updated"))
