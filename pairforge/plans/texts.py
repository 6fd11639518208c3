"""Queries of text functions, prompts, TF-IDF and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import prompts as PR
from pairforge.functions import stem as ST
from pairforge.functions import text as T
from pairforge.operators import pairs as P
from pairforge.operators import tfidf as TF
from pairforge.operators import vectors as V
from pairforge.session import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _latest_sql(name: str, key: str = "row_id") -> str:
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) AS rn FROM {name} WHERE {key} IS NOT NULL) WHERE rn = 1)"


DOCS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
#: Lower-casing by the full Unicode rule gives a dotted capital I two characters.
LOWER_DOCS = "WITH d AS (SELECT doc_id, replace(coalesce(text, ''), 'İ', 'i' || chr(775)) AS t FROM documents)"
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_FIX = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({}, chr(10), ' '), '\\.+', '.', 'g'), chr(9), ' ', 'g'), ' +', ' ', 'g'), ' \\.', '.', 'g'), '\\.+ ', '. ', 'g')"
_CHARS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[0-9]+\\.', '', 'g'), '[а-яА-Я]\\)', '', 'g'), '- ', ' ', 'g'), '^-', ''), '[;\\.–·](\\n?)$', '\\1'), '[^\\p{{L}}\\p{{N}}\\n \\-,()/\\\\!?;.]', '', 'g'), '([^.])\\n', '\\1.\n', 'g'), '([^.])\\n', '\\1.\n', 'g')"
_STRIP = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_PREP = f"array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(lower({{}}), '\\s+'), lambda x: x <> '' AND x NOT IN ({STOP})), lambda x: regexp_replace(x, '[!\"$%&''(),.:;<=>?@\\[\\]\\\\^_`{{{{|}}}}~]', '', 'g')), lambda x: x <> ''), ' ')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("fix_text", DOCS + f" SELECT doc_id, md5({_FIX.format('t')}) AS fixed FROM d")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.fix_text("text")).alias("fixed"))


@query("strip_characters", DOCS + f" SELECT doc_id, md5({_CHARS.format('t')}) AS stripped FROM d")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.strip_characters("text")).alias("stripped"))


@query("normalize_text", LOWER_DOCS + f" SELECT doc_id, md5({_FIX.format(_CHARS.format('lower(' + _STRIP.format('t') + ')'))}) AS normal FROM d")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.normalize("text", characters=True)).alias("normal"))


_TAGS = r"regexp_replace(regexp_replace({}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '(?s)(?:<[a-zA-Z/!][^>]*>)+', chr(10), 'g')"
_ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', ' '), '&#39;', chr(39)), '&amp;', '&')"
_WRAPPED = "'<p>' || t || '</p><br>&amp;'"


@query("remove_tags", DOCS + r" SELECT doc_id, md5(regexp_replace({}, '^\n+|\n+$', '', 'g')) AS plain FROM d".format(_ENTITIES.format(_TAGS.format(_WRAPPED))))
def _(spark, sf):
    wrapped = F.concat(F.lit("<p>"), T.text_or_empty("text"), F.lit("</p><br>&amp;"))
    return docs(spark, sf).select("doc_id", F.md5(T.remove_tags(wrapped)).alias("plain"))


@query("tokenize_words", LOWER_DOCS + r" SELECT doc_id, len(k) AS n_tokens, md5(array_to_string(k, ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(t), '[\p{L}\p{N}_]{2,}') AS k FROM d)")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.tokens("text").alias("k")).select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.md5(F.array_join("k", " ")).alias("tokens"))


@query("stopword_filter", LOWER_DOCS + rf" SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+'), lambda x: x NOT IN ({STOP})), ' ')) AS kept FROM d")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(F.array_join(T.without(T.words("text"), T.STOPWORDS), " ")).alias("kept"))


_MARKS = ", ".join("'" + m + "'" for m in T.PUNCTUATION)


@query("preprocess_tokens", LOWER_DOCS + rf" SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda x: x NOT IN ({_MARKS}) AND NOT regexp_matches(x, '^[0-9]') AND x NOT IN ({STOP})), ' ')) AS tokens FROM d")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(F.array_join(T.preprocess("text"), " ")).alias("tokens"))


@query("preprocess_text", LOWER_DOCS + f" SELECT doc_id, md5({_PREP.format('t')}) AS prepared FROM d")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.preprocess_text("text")).alias("prepared"))


@query(
    "sent_preprocess",
    DOCS + r""", s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?…]+[»”"'')]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM d),
c AS (SELECT doc_id, list_filter(list_transform(s, lambda x: regexp_replace(x, '[^\p{L}\p{N}_\s]|[0-9]+', '', 'g')), lambda x: x <> '') AS c FROM s)
SELECT doc_id, len(c) AS n_sentences, md5(array_to_string(c, '|')) AS sentences FROM c""",
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.sent_preprocess("text").alias("c")).select("doc_id", F.size("c").cast("long").alias("n_sentences"), F.md5(F.array_join("c", "|")).alias("sentences"))


@query(
    "word_ngrams",
    LOWER_DOCS + r""", k AS (SELECT regexp_extract_all(lower(t), '[\p{L}\p{N}_]{2,}') AS k FROM d),
g AS (SELECT unnest(list_transform(generate_series(1, len(k)), lambda i: k[i])) AS term FROM k UNION ALL SELECT unnest(list_transform(generate_series(1, len(k) - 1), lambda i: array_to_string(k[i:i+1], ' '))) FROM k WHERE len(k) > 1)
SELECT term, count(*) AS n FROM g GROUP BY term""",
)
def _(spark, sf):
    return docs(spark, sf).select(F.explode(T.ngrams(T.tokens("text"), 1, 2)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("stem_tokens", LOWER_DOCS + r", w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]{2,}')) AS word FROM d) SELECT word, " + ST.stem_sql("word") + " AS stem FROM w")
def _(spark, sf):
    """The stem of every distinct word of all texts."""
    return docs(spark, sf).select(F.explode(T.tokens("text")).alias("word")).distinct().select("word", ST.stem(F.col("word")).alias("stem"))


@query("sentence_windows")
def _(spark, sf):
    rows = P.latest(table(spark, sf, "rpd_dataset"), "row_id").select("row_id", F.posexplode(T.sentence_windows("text_rp")).alias("window_no", "w"))
    return rows.select("row_id", "window_no", F.md5("w").alias("window_text"), F.length("w").alias("letters"))


# ---- prompts

_TOK = r"len(regexp_extract_all({}, '\p{{L}}{{1,4}}|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]'))"
_STUD = f"WITH p AS (SELECT row_id AS pair_id, coalesce(text_1, '') AS t1, coalesce(text_2, '') AS t2 FROM {_latest_sql('studentor_partner')})"
_SEED = "'" + (PR.QUERY_PROMPT + "".join(PR.LABELS)).replace("'", "''") + "'"
_LIMITED = rf""", n AS (SELECT *, {_TOK.format('t1')} AS n1, {_TOK.format('t2')} AS n2, 300 - ({_TOK.format(_SEED)} + 4) AS budget FROM p),
o AS (SELECT *, greatest(0, n1 + n2 - budget) AS over, n1 - n2 + 1 AS lead_ FROM n),
l AS (SELECT *, CAST(CASE WHEN n1 < n2 THEN n1 WHEN over <= lead_ THEN n1 - over ELSE n1 - lead_ - floor((over - lead_) / 2.0) END AS INTEGER) AS c1,
 CAST(CASE WHEN n1 < n2 THEN n2 - over WHEN over <= lead_ THEN n2 ELSE n2 - ceil((over - lead_) / 2.0) END AS INTEGER) AS c2 FROM o)"""


def _partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest(table(spark, sf_dir, "studentor_partner"), "row_id").select(F.col("row_id").alias("pair_id"), "text_1", "text_2", "need_match")


@query("limit_array", _STUD + _LIMITED + " SELECT pair_id, CAST(n1 AS INTEGER) AS n1, CAST(n2 AS INTEGER) AS n2, c1, c2 FROM l")
def _(spark, sf):
    df = _partner(spark, sf).withColumn("n1", PR.count_tokens(F.col("text_1"))).withColumn("n2", PR.count_tokens(F.col("text_2")))
    budget = F.lit(300) - (PR.count_tokens(F.lit(PR.QUERY_PROMPT + "".join(PR.LABELS))) + 4)
    c1, c2 = PR.limit_pair(F.col("n1"), F.col("n2"), budget)
    return df.select("pair_id", "n1", "n2", c1.alias("c1"), c2.alias("c2"))


_CROP = rf"""array_to_string(list_filter(list_transform(generate_series(1, len(list_filter(regexp_split_to_array({{t}}, '\s+'), lambda x: x <> ''))),
 lambda i: CASE WHEN {_TOK.format("array_to_string(list_filter(regexp_split_to_array({{t}}, '\\s+'), lambda x: x <> '')[1:i], ' ')").replace('{{t}}', '{t}')} <= {{c}} THEN list_filter(regexp_split_to_array({{t}}, '\s+'), lambda x: x <> '')[i] END), lambda x: x IS NOT NULL), ' ')"""


@query("token_budget_crop", _STUD + " SELECT pair_id, md5(" + _CROP.replace("{t}", "t1").replace("{c}", "40") + ") AS cropped FROM p")
def _(spark, sf):
    return _partner(spark, sf).select("pair_id", F.md5(PR.crop_by_tokens(F.col("text_1"), F.lit(40))).alias("cropped"))


@query(
    "prompt_build",
    _STUD
    + _LIMITED
    + " SELECT pair_id, md5(concat('"
    + PR.QUERY_PROMPT
    + "', chr(10), '[[Text 1]]: ', CASE WHEN n1 + n2 > budget AND c1 < n1 THEN "
    + _CROP.replace("{t}", "t1").replace("{c}", "c1")
    + " ELSE t1 END, chr(10), '[[Text 2]]: ', CASE WHEN n1 + n2 > budget AND c2 < n2 THEN "
    + _CROP.replace("{t}", "t2").replace("{c}", "c2")
    + " ELSE t2 END, chr(10), '[[Similarity from 0 to 10]]:')) AS prompt FROM l",
)
def _(spark, sf):
    return _partner(spark, sf).select("pair_id", F.md5(PR.make_prompt(F.col("text_1"), F.col("text_2"), 300)).alias("prompt"))


@query("parse_llm_score", f"WITH p AS (SELECT row_id, coalesce(title_2, '') AS answer FROM {_latest_sql('studentor_partner')}) SELECT row_id AS pair_id, CAST(coalesce(TRY_CAST(answer AS INTEGER), TRY_CAST(nullif(regexp_extract(answer, '[0-9]+'), '') AS INTEGER)) AS BIGINT) * 10 AS value FROM p")
def _(spark, sf):
    rows = P.latest(table(spark, sf, "studentor_partner"), "row_id")
    return rows.select(F.col("row_id").alias("pair_id"), (PR.parse_score(T.text_or_empty("title_2")).cast("long") * 10).alias("value"))


@query("cache_key_md5", f"SELECT row_id AS pair_id, md5(concat_ws('---', 'openai:', '4010', 'gpt-3.5-turbo', '0.75', coalesce(text_1, ''), coalesce(text_2, ''))) AS cache_key FROM {_latest_sql('studentor_partner')}")
def _(spark, sf):
    fixed = [F.lit(x) for x in ("openai:", "4010", "gpt-3.5-turbo", "0.75")]
    return _partner(spark, sf).select("pair_id", PR.cache_key(*fixed, T.text_or_empty("text_1"), T.text_or_empty("text_2")).alias("cache_key"))


# ---- TF-IDF over the lemma views

_V6 = f"WITH v AS {_latest_sql('dataset_v6_r30')}"
_CORPUS = _V6 + ", corpus AS (SELECT row_number() OVER () AS id, t FROM (SELECT coalesce(resume_lem, '') AS t FROM v UNION ALL SELECT coalesce(vacancy_lem, '') FROM v))"
_GRAMS1 = r", toks AS (SELECT id, unnest(regexp_extract_all(lower(" + _PREP.format("t") + r"), '[\p{L}\p{N}_]{2,}')) AS term FROM {src})"


def _tfidf_sql(tail: str, tf: str = "tf", corpus: str = _CORPUS) -> str:
    return (
        corpus
        + _GRAMS1.replace("{src}", "corpus")
        + ", m AS (SELECT term, count(DISTINCT id) AS df, ln((1 + (SELECT count(*) FROM corpus)) / CAST(1 + count(DISTINCT id) AS DOUBLE)) + 1 AS idf FROM toks GROUP BY term)"
        + ", sides AS (SELECT row_id * 2 AS id, coalesce(vacancy_lem, '') AS t FROM v UNION ALL SELECT row_id * 2 + 1, coalesce(resume_lem, '') FROM v)"
        + _GRAMS1.replace("toks", "stoks").replace("{src}", "sides")
        + f", tfs AS (SELECT id, term, count(*) AS tf FROM stoks GROUP BY ALL), raw AS (SELECT id, term, CAST({tf} AS DOUBLE) * idf AS w FROM tfs JOIN m USING (term)),"
        + " wts AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"
        + ", dots AS (SELECT a.id // 2 AS pair_id, sum(a.weight * b.weight) * 100 AS value FROM wts a JOIN wts b ON a.id % 2 = 0 AND b.id = a.id + 1 AND a.term = b.term GROUP BY a.id)"
        + tail
    )


def _v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.latest(table(spark, sf_dir, "dataset_v6_r30"), "row_id")
    return rows.select(F.col("row_id").alias("pair_id"), F.col("vacancy_lem").alias("text_1"), F.col("resume_lem").alias("text_2"), F.coalesce(F.col("result") == "1", F.lit(False)).alias("need_match"))


def _tfidf(spark, sf, params: TF.TfIdfParams) -> DataFrame:
    pairs = _v6(spark, sf)
    return TF.match(pairs, TF.fit(P.all_texts(pairs), params), params)


@query("tfidf_df", _tfidf_sql(" SELECT term, df FROM m"))
def _(spark, sf):
    return TF.fit(P.all_texts(_v6(spark, sf)), TF.TfIdfParams()).select("term", "df")


@query("tfidf_weights", _tfidf_sql(" SELECT id, term, round(weight, 9) AS weight FROM wts"))
def _(spark, sf):
    pairs, params = _v6(spark, sf), TF.TfIdfParams()
    sides = pairs.select(F.explode(F.array(F.struct((F.col("pair_id") * 2).alias("id"), T.text_or_empty("text_1").alias("text")), F.struct((F.col("pair_id") * 2 + 1).alias("id"), T.text_or_empty("text_2").alias("text")))).alias("s")).select("s.*")
    return TF.transform(sides, TF.fit(P.all_texts(pairs), params), params, key="id").select("id", "term", F.round("weight", 9).alias("weight"))


_VALUE = " SELECT row_id AS pair_id, round(coalesce(value, 0.0), 6) AS value FROM v LEFT JOIN dots ON row_id = pair_id"


@query("tfidf_match", _tfidf_sql(_VALUE))
def _(spark, sf):
    return _tfidf(spark, sf, TF.TfIdfParams()).select("pair_id", F.round("value", 6).alias("value"))


@query("tfidf_binary_sublinear", _tfidf_sql(_VALUE, tf="(1 + ln(1.0::DOUBLE))"))
def _(spark, sf):
    return _tfidf(spark, sf, TF.TfIdfParams(binary=True, sublinear=True)).select("pair_id", F.round("value", 6).alias("value"))


@query("tfidf_sublinear", _tfidf_sql(_VALUE, tf="(1 + ln(tf))"))
def _(spark, sf):
    return _tfidf(spark, sf, TF.TfIdfParams(sublinear=True)).select("pair_id", F.round("value", 6).alias("value"))


@query("tfidf_config_sweep")
def _(spark, sf):
    """All ranges of n-grams, then all flags with the best range, fitted on the lemma views."""
    from pairforge.operators import experiments as EX

    return EX.tfidf_runs(_v6(spark, sf), key=EX.best_by("dataset_v6_r30"))


# ---- vectors

_EMB = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_COS = "list_dot_product({0}, {1}) / nullif(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 0)"


@query("cosine_dense", _EMB + f" SELECT a.vec_id, round({_COS.format('a.v', 'b.v')}, 9) AS value FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 9).alias("value"))


@query("vocab_min_count", "SELECT word, count(*) AS n FROM (SELECT unnest(preprocessed_text) AS word FROM documents_preprocessed) WHERE word IS NOT NULL AND word <> '' GROUP BY word HAVING count(*) >= 5")
def _(spark, sf):
    return V.vocabulary(table(spark, sf, "documents_preprocessed"), "preprocessed_text", 5)


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of the table for each usual word, by its digest."""
    words = V.vocabulary(table(spark, sf_dir, "documents_preprocessed"), "preprocessed_text", 20).where(F.col("word").rlike(r"^[\p{L}]+$"))
    place = words.withColumn("slot", (F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("long") % 500)).select("word", "slot")
    return place.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("vec")), "slot").select("word", "vec")


_WV = r"""WITH words AS (SELECT word FROM (SELECT unnest(preprocessed_text) AS word FROM documents_preprocessed) WHERE word IS NOT NULL GROUP BY word HAVING count(*) >= 20 AND regexp_matches(word, '^\p{L}+$')),
wv AS (SELECT word, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM (SELECT word, CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) % 500 AS slot FROM words) JOIN embeddings ON vec_id = slot),
p AS """ + _latest_sql("rpd_dataset") + r""",
t AS (SELECT row_id * 2 AS id, unnest(regexp_extract_all(lower(coalesce(text_rp, '')), '[\p{L}\p{N}_]{2,}')) AS word FROM p UNION ALL SELECT row_id * 2 + 1, unnest(regexp_extract_all(lower(coalesce(text_proj, '')), '[\p{L}\p{N}_]{2,}')) FROM p),
x AS (SELECT id, unnest(v) AS x, unnest(generate_series(1, len(v))) AS pos FROM t JOIN wv USING (word)),
a AS (SELECT id, list(m ORDER BY pos) AS v FROM (SELECT id, pos, avg(x) AS m FROM x GROUP BY ALL) GROUP BY id)"""


@query("in_vocabulary", _WV.split(",\nx AS")[0] + " SELECT id AS text_id, count(*) AS known FROM t WHERE word IN (SELECT word FROM wv) GROUP BY id")
def _(spark, sf):
    words = _rpd_tokens(spark, sf).select("text_id", F.explode("tokens").alias("word"))
    return words.join(word_vectors(spark, sf).select("word"), "word", "left_semi").groupBy("text_id").agg(F.count("*").alias("known"))


def _rpd_tokens(spark, sf) -> DataFrame:
    rows = P.latest(table(spark, sf, "rpd_dataset"), "row_id")
    sides = F.array(F.struct((F.col("row_id") * 2).alias("text_id"), T.tokens("text_rp").alias("tokens")), F.struct((F.col("row_id") * 2 + 1).alias("text_id"), T.tokens("text_proj").alias("tokens")))
    return rows.select(F.explode(sides).alias("s")).select("s.*")


@query("mean_vector_similarity", _WV + f" SELECT row_id AS pair_id, round(round({_COS.format('l.v', 'r.v')}, 9), 3) AS value FROM p LEFT JOIN a l ON l.id = row_id * 2 LEFT JOIN a r ON r.id = row_id * 2 + 1")
def _(spark, sf):
    rows = P.latest(table(spark, sf, "rpd_dataset"), "row_id")
    pairs = rows.select(F.col("row_id").alias("pair_id"), (F.col("row_id") * 2).alias("id_1"), (F.col("row_id") * 2 + 1).alias("id_2"))
    return V.mean_vector_match(pairs, _rpd_tokens(spark, sf), word_vectors(spark, sf))


@query(
    "sentence_max_mean",
    _EMB + f", s AS (SELECT vec_id // 5 AS text_id, vec_id AS sent, v FROM e), b AS (SELECT x.text_id AS pair_id, x.sent, max({_COS.format('x.v', 'y.v')}) AS best FROM s x JOIN s y ON y.text_id = x.text_id + 1 GROUP BY ALL) SELECT pair_id, round(round(avg(best), 9), 3) AS value FROM b GROUP BY pair_id",
)
def _(spark, sf):
    sents = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("text_id"), F.col("vec_id").alias("sent"), F.col("embedding").alias("vec"))
    ids = sents.select("text_id").distinct()
    return V.sentence_max_mean(ids.select(F.col("text_id").alias("pair_id"), F.col("text_id").alias("id_1"), (F.col("text_id") + 1).alias("id_2")), sents)
