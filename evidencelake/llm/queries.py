"""The registered queries: each operator over its whole table, with the digest columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.llm import bitpack, chat_format, decontaminate, hard_negatives, language_id, lexical_search, line_dedup, lm_scoring, mixing, ngram_join, repetition, secret_scan, url_graph
from evidencelake.session import configure, fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register under the function's name, with its DuckDB SQL where there is some."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Output shards of the mix, and blocks in each.
MIX_SHARDS, MIX_BLOCKS = 64, 64


def _mix_sql() -> str:
    """The targets by water filling, then the tree, a table for each level."""
    levels = ""
    for level in range((MIX_SHARDS - 1).bit_length()):
        levels += f"""
drawn{level} AS (SELECT *, width // 2 AS half, row_number() OVER (PARTITION BY lo ORDER BY md5('0:' || lo || ':' || width || ':' || rank || ':' || token), rank, token) <= count(*) OVER (PARTITION BY lo) * (width // 2) // width AS goes_left FROM nodes{level}),
nodes{level + 1} AS (SELECT rank, token, CASE WHEN half = 0 OR goes_left THEN lo ELSE lo + half END AS lo, CASE WHEN half = 0 THEN width WHEN goes_left THEN half ELSE width - half END AS width FROM drawn{level}),"""
    copy = lambda e, column: f"SELECT row, {e} AS e, {column} AS place FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source WHERE {column} + placed.size / 2.0::DOUBLE < target"
    return rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, row_number() OVER () AS row FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
weighted AS (SELECT *, 2 * source_size AS cap, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) OVER () AS weights FROM sources),
filled AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS caps_before, coalesce(sum(weight) OVER w, 0) AS weights_before FROM weighted WINDOW w AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, cap * (weights - weights_before)::DOUBLE <= weight * (budget - caps_before) AS whole FROM filled),
level AS (SELECT (max(budget) - coalesce(sum(cap) FILTER (whole), 0)) / sum(weight) FILTER (NOT whole) AS level FROM judged),
targets AS (SELECT source, source_size, rank, CASE WHEN whole THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * level) END AS target FROM judged, level),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':0'), doc_id NULLS FIRST, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized),
stretch AS (SELECT greatest(1, ceil(round(sum(target), 3) / {MIX_SHARDS * MIX_BLOCKS}))::BIGINT AS words FROM targets),
quotas AS (SELECT rank, ceil(target / words)::BIGINT AS q FROM targets, stretch),
nodes0 AS (SELECT rank, unnest(range(1, q + 1)) AS token, 0::BIGINT AS lo, {MIX_SHARDS}::BIGINT AS width FROM quotas),{levels}
leaves AS (SELECT rank, lo AS shard, row_number() OVER (PARTITION BY rank ORDER BY lo, token) AS turn FROM nodes{(MIX_SHARDS - 1).bit_length()}),
permuted AS (SELECT rank, block, row_number() OVER (PARTITION BY rank ORDER BY md5('0:' || rank || ':' || block), block) AS turn FROM (SELECT rank, unnest(range(0, q)) AS block FROM quotas)),
dealt AS (SELECT rank, block, shard FROM permuted JOIN leaves USING (rank, turn)),
copies AS ({copy(0, "before")} UNION ALL {copy(1, "before + source_size")}),
given AS (SELECT c.row, e, shard FROM copies c JOIN placed p USING (row) JOIN targets t ON p.source IS NOT DISTINCT FROM t.source CROSS JOIN stretch JOIN dealt d ON d.rank = t.rank AND d.block = c.place // words),
listed AS (SELECT row, count(*) AS n, string_agg(shard || '/' || left(md5('0:' || shard || ':' || coalesce(doc_id::VARCHAR, '') || ':' || e), 8), ',' ORDER BY e) AS placed_in FROM given JOIN placed USING (row) GROUP BY row)
SELECT p.doc_id, p.size, t.source_size, t.target, (p.size * coalesce(n, 0))::BIGINT AS taken, coalesce(placed_in, '') AS placed_in
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN listed USING (row)"""


@query(_mix_sql())
def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2 by source: doc_id, size, source_size, target, taken, and placed_in: shard and place there of each copy."""
    drawn = mixing.plan_mix(table(spark, sf_dir, "documents"), shards=MIX_SHARDS, blocks_per_shard=MIX_BLOCKS)
    spots = F.array_join(F.transform(F.arrays_zip("shards", "places"), lambda c: F.concat(c["shards"].cast("string"), F.lit("/"), F.left(c["places"], F.lit(8)))), ",")
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), spots.alias("placed_in"))


#: Of the public tokenizer ``word_bpe_49k.json``: ids are below this, and the id that closes a document.
VOCABULARY, END_ID = 49_408, 2


def token_file_digests(spark: SparkSession, docs: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and digest what is read back from them."""
    path = fresh_path(spark, "tokens")
    bitpack.write_token_files(docs, path, tokenizer_file(), VOCABULARY, END_ID, direct=True, order=order)
    return bitpack.document_digests(bitpack.read_token_files(spark, path))


def file_order(docs: DataFrame) -> list[Column] | None:
    """The order in which the files of a written table hold its rows; None for a frame that is not one."""
    order = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        docs.select(*order).schema  # noqa: B018 - resolves the columns
    except AnalysisException:
        return None
    return order


@query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width bit-packed token files of all documents: doc_id, start, n_tokens, ids_crc32, read back from the files."""
    return token_file_digests(spark, table(spark, sf_dir, "documents"))


_HOST_SQL = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINES_SQL = rf"""
WITH pieces AS (
  SELECT page_id, {_HOST_SQL} AS site,
    list_filter(list_transform(string_split_regex(regexp_replace(coalesce(html, ''), '(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '<>', 'g'), '<[^>]*>|\n'), lambda x: trim(x)), lambda x: x <> '') AS lines,
    row_number() OVER () AS page
  FROM pages),
each AS (SELECT DISTINCT site, page, unnest(lines) AS line FROM pieces),
totals AS (SELECT site, count(*) AS site_pages FROM pieces GROUP BY site),
bad AS (SELECT site, line FROM each JOIN totals USING (site) GROUP BY site, line, site_pages HAVING count(*) >= 2 AND count(*) > 0.1 * site_pages),
lists AS (SELECT site, list(line) AS bad FROM bad GROUP BY site),
kept AS (SELECT page_id, pieces.site, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM pieces LEFT JOIN lists USING (site))
SELECT page_id, site, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM kept"""


@query(_LINES_SQL)
def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages without their host's boilerplate lines: page_id, site, n_lines, n_dropped, text."""
    pages = table(spark, sf_dir, "pages")
    cleaned = line_dedup.drop_boilerplate(pages, line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")))
    return cleaned.select("page_id", "site", "n_lines", "n_dropped", "text")


_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t')"
_CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
pieces AS (
  SELECT *, length('### ' || replace({_ESCAPED.format("role")}, ':', '\\c') || ': ' || {_ESCAPED.format("text")} || '</turn>' || chr(10)) AS piece, role = 'assistant' AS reply,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows),
held AS (SELECT *, sum(reply::INT) OVER (PARTITION BY conv_id ORDER BY i DESC) + max((i = n AND NOT reply)::INT) OVER (PARTITION BY conv_id) AS examples FROM pieces)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (reply), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (reply), '')) AS loss_sha256, sum(piece * examples)::BIGINT AS formatted_chars
FROM held GROUP BY conv_id"""


@query(_CHAT_SQL)
def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 as prefix-target examples, digested from the formatted texts."""
    sample = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(sample)
    return chat_format.read_back(chat_format.prefix_examples(turns))


@query()
def op3_benchmark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, however reordered: doc_id, item_id, coverage, tiles, longest_tile."""
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by their repetition: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and what kept rests on."""
    return repetition.repetition(table(spark, sf_dir, "documents"), columns=["doc_id"])


@query()
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of texts that share three quarters of their 5-word shingles: doc_id, n_shingles, component_id."""
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score; learned from documents that are not held out."""
    docs, file = table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    known = docs.filter(~held_out & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    langs, probs = language_id.fit(language_id.sampled(known, language_id.TRAIN_TEXTS, "doc_id").select("lang", "text"), file)
    return language_id.identify(docs, langs, probs, file, extra={"held_out": held_out})


URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_ROUNDS, _DAMPING = 8, 0.6


def _url_sql() -> str:
    """The same power iteration, a table for each round."""
    rule, verdict = "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"
    for what, r in sorted(URL_RULES, key=lambda x: len(x[1])):
        name, start = r.split("/", 1)
        rule = f"CASE WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{r}' ELSE {rule} END"
        verdict = f"CASE WHEN rule = '{r}' THEN '{what}' ELSE {verdict} END"
    rounds = ", ".join(
        f"m{i} AS (SELECT kind, spot, sum(mass) AS mass FROM (SELECT kind, spot, seed * {1 - _DAMPING} AS mass FROM seeds UNION ALL SELECT kind, dst, mass * share * {_DAMPING} FROM m{i - 1} JOIN steps USING (kind, spot)) GROUP BY kind, spot)"
        for i in range(1, _ROUNDS + 1)
    )
    return rf"""
WITH urls AS (SELECT page_id, {_HOST_SQL} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_transform(regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''> ]+)', 1), lambda h: translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS links, row_number() OVER () AS page FROM pages),
ruled AS (SELECT *, {rule} AS rule FROM urls),
own AS (SELECT *, {verdict} AS ruled FROM ruled),
hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM own WHERE host <> '' GROUP BY host),
whole AS (SELECT sum(pages)::DOUBLE AS pages, greatest(sum(allowed), 1)::DOUBLE AS allowed, greatest(sum(blocked), 1)::DOUBLE AS blocked FROM hosts),
linked AS (SELECT DISTINCT page, host, unnest(links) AS dst FROM own WHERE host <> ''),
parts AS (SELECT host, string_split(host, '.') AS p FROM hosts),
nodes AS (SELECT host FROM hosts UNION SELECT unnest(list_transform(range(2, len(p)), lambda i: array_to_string(p[i:], '.'))) FROM parts WHERE length(host) <= {url_graph.LONGEST_HOST} AND NOT regexp_matches(host, '^[0-9.]+(:[0-9]*)?$')),
pairs AS (SELECT a.host, b.host AS parent FROM nodes a JOIN nodes b ON b.host = regexp_extract(a.host, '^[^.]*\.(.*)$', 1) WHERE b.host <> ''),
edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT host AS src, dst, count(*)::DOUBLE AS weight FROM linked WHERE host <> dst GROUP BY host, dst
  UNION ALL SELECT host, parent, 1.0::DOUBLE FROM pairs UNION ALL SELECT parent, host, 1.0::DOUBLE FROM pairs) GROUP BY src, dst),
directed AS (SELECT 'trust' AS kind, src AS spot, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
steps AS (SELECT kind, spot, dst, weight / sum(weight) OVER (PARTITION BY kind, spot) AS share FROM directed),
seeds AS (SELECT 'trust' AS kind, host AS spot, hosts.allowed / whole.allowed AS seed FROM hosts, whole WHERE hosts.allowed > 0 UNION ALL SELECT 'distrust', host, hosts.blocked / whole.blocked FROM hosts, whole WHERE hosts.blocked > 0),
m0 AS (SELECT kind, spot, seed AS mass FROM seeds), {rounds},
scores AS (SELECT spot AS host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM m{_ROUNDS} GROUP BY spot),
bad AS (SELECT scores.host, distrust > trust AND distrust >= hosts.pages / whole.pages AS bad FROM scores JOIN hosts USING (host), whole)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM own LEFT JOIN bad USING (host)"""


@query(_url_sql())
def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rule, else by the trust and distrust of its host: page_id, host, path, rule, verdict."""
    judged = url_graph.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, damping=_DAMPING, rounds=_ROUNDS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op1_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by their likeness to those labelled of good quality: doc_id, n_tokens, target_bits, background_bits, score."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good, tokenizer_file(), VOCABULARY, opening=49_406, direct=True)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SEARCH_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS doc, {_TERMS} AS terms FROM documents),
counted AS (SELECT doc_id, doc, terms, len(terms)::BIGINT AS length FROM docs WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS texts, sum(length)::BIGINT AS words FROM counted),
items AS (SELECT item_id, item, unnest(list_distinct(terms)) AS term FROM (SELECT item_id, row_number() OVER () AS item, {_TERMS} AS terms FROM benchmark)),
held AS (SELECT doc_id, doc, length, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, doc, length, unnest(terms) AS term FROM counted) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), whole),
parts AS (SELECT doc_id, doc, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * length * texts) // words))) AS part FROM held JOIN weights USING (term), whole),
scored AS (SELECT item_id, item, doc_id, doc, sum(part)::BIGINT AS score FROM items JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10"""


@query(_SEARCH_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for each benchmark item: item_id, rank, doc_id, score of the ten best."""
    return lexical_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_NEGATIVES_SQL = """
WITH usable AS (SELECT row_number() OVER () AS row, vec_id, label, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
codes AS (SELECT row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: try_cast(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM usable),
scored AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM codes a JOIN codes b ON a.vec_id % 100 = 0 AND a.row <> b.row),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id NULLS LAST)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5"""


@query(_NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors (vec_id divisible by 100): anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query()
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: doc_id, n_assign, n_access, n_hex, base_sha256 and spans, known forms and novel strings together."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secret_scan.span_list(F.filter("secrets", lambda s: s["kind"] != "novel"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secret_scan.span_list(F.col("secrets")).alias("spans"))
