"""The registered queries of the corpus operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, divergence, interaction, jaccard, langid, line_dedup, spotsigs, token_counts, token_store, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.attribute(_table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, keep_text=False)
    return bpe.decode(coded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _server_log(rows: DataFrame, piece: int = 48) -> DataFrame:
    """Rows (conv_id, turn, copy, role, text) as the log that a model server would leave. The final text of a message is
    nowhere in one piece: it streams in deltas of ``piece`` characters. Every third message begins with a draft that an
    edit voids; every fifth is regenerated after another message that came behind it, which is void with it.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    draft = F.concat(F.lit("draft: "), F.reverse(F.substring(text, 1, piece)))
    parts = F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / piece).cast("int")), lambda i: F.substring(text, i * piece + 1, F.lit(piece))))
    what = F.pmod(F.xxhash64("conv_id", "turn", "copy"), F.lit(15))
    event = lambda at, kind, later, role, own: F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), F.lit(later).alias("later"), role.alias("role"), own.alias("text"))
    none, empty = F.lit(None).cast("string"), F.lit("")
    at = lambda n: F.lit(n)
    plain = F.array(event(at(0), "message", 0, role, empty))
    edited = F.array(event(at(0), "message", 0, role, draft), event(at(1), "delta", 0, none, draft), event(at(2), "edit", 0, none, empty))
    again = F.array(
        event(at(0), "message", 0, F.lit("void"), draft), event(at(1), "message", 1, role, draft), event(at(2), "delta", 1, none, F.lit("void")), event(at(3), "regenerate", 0, role, empty)
    )
    begun = F.when(what % 5 == 0, again).when(what % 3 == 0, edited).otherwise(plain)
    deltas = F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda p, i: event(i + 10, "delta", 0, none, p))
    logged = rows.select("conv_id", "turn", "copy", F.explode(F.concat(begun, deltas)).alias("e"))
    # The message behind is named as one that may never come, or come later.
    return logged.select("conv_id", F.struct("turn", "copy", "e.at").alias("seq"), "e.kind", "turn", (F.col("copy") + F.col("e.later")).alias("copy"), "e.role", "e.text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    # Rows of one turn that differ are messages of their own; equal ones too, so each gets a number.
    numbered = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    by = ("turn", "copy")
    out = chat.render(chat.fold(_server_log(numbered), by), by)
    out = out.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, _table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("spans")).cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantize(F.col("embedding")).alias("x"))
    return topk.top_k(rows, F.col("vec_id") % 20 == 0)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.new_store(spark)
    token_store.write(_table(spark, sf_dir, "documents"), store)
    return token_store.read(spark, store).select("doc_id", "start", "n_tokens", F.crc32("raw").alias("ids_crc32"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    prototypes = langid.learn(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), prototypes).drop("text")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spotsigs.fingerprints(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_chat_format": op3_chat_format,
    "op4_decontaminate": op4_decontaminate,
    "op5_top_k": op5_top_k,
    "op6_token_store": op6_token_store,
    "op7_line_dedup": op7_line_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_filter_interaction": op12_filter_interaction,
    "op13_spot_signatures": op13_spot_signatures,
}


def _url_sql() -> str:
    """The verdict where no rule fits: each term between characters that are no letter a-z or digit."""
    has = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    weight = " + ".join([f"{urls.LIMIT} * {has(t)}::INT" for t in urls.STRICT] + [f"{has(t)}::INT" for t in urls.SOFT])
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    return f"""
WITH p AS (SELECT page_id, {_LOW.format("url")} AS low,
    {_LOW.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")} AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(v, h, p) AS (VALUES {rules}),
m AS (SELECT page_id, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(v, length(h || r.p)) AS v
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {weight} >= {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)"""


_LINES = r"[\x20\x09-\x0D]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _interaction_sql() -> str:
    """Every order is applied to every document, filter after filter."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) < doc_id AS e FROM d),
f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    CASE WHEN len(w) < {interaction.MIN_WORDS} THEN 'A' ELSE '' END ||
    CASE WHEN 100 * len(list_distinct(w)) < {interaction.MIN_DISTINCT} * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {interaction.MAX_CAPITALS} * length(t) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN labels USING (doc_id)),
l(x) AS (SELECT unnest(['A', 'B', 'C', 'D', 'E'])),
o AS (SELECT a.x || b.x || c.x || g.x || h.x AS filter_order FROM l a, l b, l c, l g, l h
  WHERE len(list_distinct([a.x, b.x, c.x, g.x, h.x])) = 5),
s AS (SELECT part, filter_order, step, good, toxic, fails, filter_order[step] AS letter, contains(fails, filter_order[step]) AS fail,
    len(list_filter(string_split(fails, ''), lambda x: x <> '' AND contains(left(filter_order, step - 1), x))) > 0 AS gone
  FROM f, o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, letter, count(*) FILTER (NOT gone AND NOT fail) AS kept, count(*) FILTER (NOT gone AND fail) AS removed,
    count(*) FILTER (gone AND fail) AS redundant, count(*) FILTER (fails = letter) AS unique_fails,
    count(*) FILTER (NOT gone AND fail AND good) AS good_lost, count(*) FILTER (NOT gone AND fail AND toxic) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""


def _spot_sql() -> str:
    common = ", ".join(f"'{a}'" for a in sorted(set(spotsigs.ANCHORS)))
    chain = spotsigs.CHAIN
    near = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS follows FROM documents
  WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(t, length(t) - length(t) // 4) || left(follows, length(t) // 4) AS edit FROM d),
x AS (SELECT doc_id, 'own' AS what, t FROM e UNION ALL SELECT doc_id, 'edit', edit FROM e UNION ALL SELECT doc_id, 'next', follows FROM e),
w AS (SELECT doc_id, what, regexp_extract_all({_LOW.format("t")}, '{_WORD}') AS w FROM x),
p AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({common})) AS spots, list_filter(w, lambda x: x NOT IN ({common})) AS content FROM w),
g AS (SELECT doc_id, what, w, list_sort(list_distinct(list_filter(list_transform(spots, lambda i, j: CASE WHEN i - j + {chain} <= len(content)
    THEN w[i] || ' ' || array_to_string(content[i - j + 1:i - j + {chain}], ' ') END), lambda s: s IS NOT NULL))) AS g FROM p),
s AS (SELECT doc_id, what, CASE WHEN len(g) > 0 THEN g WHEN len(w) > 0 THEN [' ' || array_to_string(w, ' ')] ELSE [] END AS g FROM g),
a AS (SELECT doc_id, max(g) FILTER (what = 'own') AS g, max(g) FILTER (what = 'edit') AS ge, max(g) FILTER (what = 'next') AS gn FROM s GROUP BY 1)
SELECT doc_id, length(t) AS n_chars, sha256(edit) AS edited_sha256, sha256(array_to_string(g, chr(10))) AS fingerprint,
  sha256(array_to_string(ge, chr(10))) AS edited_fingerprint, {near("g", "ge")} AS near_edited, {near("g", "gn")} AS near_next
FROM e JOIN a USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op11_source_divergence": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOW.format("text")} AS t FROM documents),
t AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= {divergence.MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + {divergence.SMOOTH}) // (coalesce(n.n, 0) + {divergence.SMOOTH} * l.v)) AS p,
    1 + ({divergence.SCALE}::HUGEINT * (k.n + {divergence.SMOOTH}) // (l.n + {divergence.SMOOTH} * l.v)) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM s WHERE part = 'pair' OR rank <= {divergence.RANKS}""",
    "op12_filter_interaction": _interaction_sql(),
    "op13_spot_signatures": _spot_sql(),
    "op3_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '(<|\[)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 10 + n + 10 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op4_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '{_WORD}') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW.format("text")}, '{_WORD}') AS w FROM benchmark),
k AS (SELECT item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s, w FROM i WHERE len(w) > 0),
b AS (SELECT DISTINCT item, w[s:s + least(len(w), 10) - 1] AS g FROM k),
z AS (SELECT DISTINCT len(g) AS n FROM b),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, z WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.s, p.n, b.item FROM p JOIN b ON p.w[p.s:p.s + p.n - 1] = b.g),
c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM h) GROUP BY 1),
j AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(j.n, 0)::BIGINT AS n_items,
  sha256(coalesce(j.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN j USING (doc_id)""",
    "op5_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOW.format(f"regexp_replace(line, '^{_LINES}+|{_LINES}+$', '', 'g')")} AS key FROM l),
m AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, m.key IS NOT NULL AND doc_id <> m.last AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op8_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.node = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)""",
    "op10_url_filter": _url_sql(),
}
