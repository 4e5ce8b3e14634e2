"""The queries of the engine by name, each over whole tables, and DuckDB SQL for the same rows.

The tables stand in for what the engine reads: a row of `documents` is a page (its source the file, its place among the source's rows
the page number), a row of `embeddings` a stored vector whose label is the collection and whose id is the document's, a `benchmark` item a
question, a turn of `conversations` a line that a user typed or an answer that a model gave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.template import Template
from ..operators import answering, blocks, retrieval, store
from ..operators.buckets import BucketTable
from ..operators.chunking import chunk_pages, numbered, split_pages
from ..operators.models import FirstLineGenerator, HashingEmbedder, with_answers
from ..operators.pivots import PivotIndex
from ..operators.reports import ingest_report, ingest_total
from ..functions.ranking import positions
from ..operators.stages import expression, lifted, passed, record
from ..sources.scratch import scratch
from ..sources.tables import pages_of, table
from ..streaming.questions import QuestionLog, follow_questions

SIZE, OVERLAP, BATCH, K, DIM = 1200, 200, 64, 5, 64


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return pages_of(table(spark, d, "documents"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return numbered(split_pages(_pages(spark, d), SIZE, OVERLAP))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.question(F.col("text")).alias("question"))
    return rows.withColumn("vector", T.hashed_vector(F.col("question"), DIM))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("collection"), "embedding")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every question with the text and place of their document, where there is one."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_file"), F.col("doc_id").alias("page"), F.col("text").alias("document"))
    return retrieval.top_batch(_stored(spark, d), _questions(spark, d), K).join(docs, "id")


def src_list(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "documents").select(F.concat(F.lit("/corpus/"), "source", F.lit(".pdf")).alias("path")).distinct()
    return paths.withColumn("source_file", T.base_name(F.col("path"))).orderBy("path")


def page_scan(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d)


def chunk_full(spark: SparkSession, d: str) -> DataFrame:
    return chunk_pages(_pages(spark, d), SIZE, OVERLAP)


def chunk_small(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are no longer than a chunk."""
    return chunk_pages(_pages(spark, d).filter(F.length("page_content") <= SIZE), SIZE, OVERLAP)


def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Longer pages whose lines are all shorter than a chunk: merged from whole lines."""
    longest = F.array_max(F.transform(F.split("page_content", "\n"), F.length))
    return chunk_pages(_pages(spark, d).filter((F.length("page_content") > SIZE) & (longest < SIZE - 1)), SIZE, OVERLAP)


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """What holds for all chunks; each page's text is beside the array of its chunks, once, and is counted there."""
    rows = split_pages(_pages(spark, d).withColumn("whole", F.col("page_content")), SIZE, OVERLAP)
    lengths = F.transform("chunks", F.length)
    amiss = lambda test: F.coalesce(F.sum(F.size(F.filter("chunks", test)).cast("long")), F.lit(0))
    return rows.agg(
        F.coalesce(F.sum(F.col("n_chunks").cast("long")), F.lit(0)).alias("n_chunks"), F.max(F.array_max(lengths)).alias("longest"), F.sum(F.aggregate(lengths, F.lit(0).cast("long"), lambda n, x: n + x)).alias("chars"),
        amiss(lambda c: F.length(c) > SIZE).alias("too_long"), amiss(lambda c: ~F.contains("whole", c)).alias("not_in_page"), amiss(lambda c: T.strip(c) != c).alias("not_stripped"),
    )


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("source_file", "page", "pos", "chunk_index")


def chunk_id(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("source_file", "chunk_index", T.chunk_id(F.col("source_file"), F.col("page"), F.col("chunk_index"), F.col("chunk")).alias("id"))


def chunk_id_missing_meta(spark: SparkSession, d: str) -> DataFrame:
    """Ids of whole documents whose metadata lack the file (English ones) or the page (those of up to 1000 characters)."""
    rows = table(spark, d, "documents")
    file, page = F.when(F.col("lang") != "en", F.col("source")), F.when(F.col("n_chars") > 1000, F.col("doc_id").cast("int"))
    return rows.select("doc_id", T.chunk_id(file, page, F.lit(0), F.col("text")).alias("id"))


def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    return store.batches(_chunks(spark, d), BATCH)


def ingest_report_(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    return ingest_report(pages, chunk_pages(pages, SIZE, OVERLAP))


def ingest_total_(spark: SparkSession, d: str) -> DataFrame:
    return ingest_total(ingest_report_(spark, d))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """All documents are stored; an edit of every labelled one and all benchmark items come in."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.col("text").alias("document"), "doc_id")
    edits = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id").select("id", F.concat(F.lit("edited: "), "document").alias("document"))
    items = table(spark, d, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("id"), F.col("text").alias("document"))
    return store.merged(docs.drop("doc_id"), edits.unionByName(items))


def store_reset(spark: SparkSession, d: str) -> DataFrame:
    return store.without_collection(_stored(spark, d), 1).select("id", "collection")


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every question's distance to every stored vector, by blocks; the questions are the stated, smaller side."""
    rows = _stored(spark, d)
    pairs = blocks.packed(rows, "id", "embedding").crossJoin(blocks.asked_blocks(blocks.packed(_questions(spark, d), "qid", "vector", blocks.ASKED)))
    found = blocks.met(pairs, blocks.ROWS, "qid", "id", "bigint", "bigint")
    return found.select("qid", "id", (F.round("distance", 6) + 0.0).alias("distance"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "rank", "id", (F.round("distance", 6) + 0.0).alias("distance"))


def topk_single(spark: SparkSession, d: str) -> DataFrame:
    """For the first stored vector as the question."""
    rows = _stored(spark, d)
    question = rows.orderBy("id").select("embedding").first()
    if question is None:
        return spark.createDataFrame([], "rank int, id long, distance double")
    best = retrieval.top_single(rows, list(question[0]), K)
    return best.select("rank", "id", (F.greatest(F.round("distance", 6), F.lit(0.0)) + 0.0).alias("distance"))


def topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.top_batch(_stored(spark, d), _questions(spark, d), K))


def topk_collection(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.top_batch(_stored(spark, d).filter("collection = 1"), _questions(spark, d), K))


def topk_short(spark: SparkSession, d: str) -> DataFrame:
    """More neighbours asked for than collection 0 has, and a collection without rows: every question stays."""
    rows, asked = _stored(spark, d), _questions(spark, d)
    found = retrieval.ordered(rows.filter("collection = 0"), asked).select("qid", "rank", "id")
    none = retrieval.top_batch(rows.filter("collection = -1"), asked, K).select("qid", "rank", "id")
    tagged = [asked.select("qid").join(x, "qid", "left").withColumn("collection", F.lit(c)) for x, c in ((found, 0), (none, -1))]
    return tagged[0].unionByName(tagged[1])


def topk_by_collection(spark: SparkSession, d: str) -> DataFrame:
    """Each question in a collection of its own choice: that of its number's last digit."""
    asked = _questions(spark, d).withColumn("collection", (F.col("qid") % 10).cast("int"))
    return _rounded(retrieval.top_by_key(_stored(spark, d), asked, K))


def topk_pruned(spark: SparkSession, d: str) -> DataFrame:
    """topk_batch through a pivot index, which passes over what can't be near."""
    index = PivotIndex(spark, scratch(spark, "pivots")).build(_stored(spark, d))
    return _rounded(index.search(_questions(spark, d), K)[0])


def upsert_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The buckets that an upsert rewrote: all documents are stored in 256 buckets; edits of the labelled toxic ones come in."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.col("text").alias("document"), "doc_id")
    edits = docs.join(table(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct(), "doc_id").select("id", F.concat(F.lit("edited: "), "document").alias("document"))
    held = BucketTable(spark, scratch(spark, "upsert"), "id string, document string", buckets=256)
    old, new = held.upsert(docs.drop("doc_id")), held.upsert(edits)
    return held.changes(old, new).select("bucket", "rows", "replaced")


def embed_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Per source: texts, and how many of them had to be embedded for a store whose cache has all English texts. A text that occurs often is embedded once."""
    cache = store.VectorCache(spark, scratch(spark, "reuse"), 16)
    docs, embedder = table(spark, d, "documents").select("source", "lang", F.col("text").alias("document")), HashingEmbedder(8)
    cache.fill(docs.filter("lang = 'en'"), embedder)
    known = cache.read().select("content")
    cache.fill(docs, embedder)
    keyed = docs.withColumn("content", T.content_key(embedder.name, F.col("document")))
    new = cache.read().select("content").join(known, "content", "left_anti").withColumn("new", F.lit(True))
    return keyed.join(new, "content", "left").groupBy("source").agg(F.count("*").alias("texts"), F.count_distinct(F.when(F.col("new"), F.col("content"))).alias("embedded"))


def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their page's metadata as a variant: a field of the table, one that only some pages have, one that none has, and the label made of them."""
    some = F.struct("source", "lang", F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("size"), F.struct(F.col("doc_id").alias("id")).alias("own"))
    docs = table(spark, d, "documents").withColumn("metadata", F.to_json(some))
    pages = _pages(spark, d).join(docs.select("doc_id", "metadata", F.col("source").alias("source_file"), F.col("text").alias("page_content")).transform(_paged), ["source_file", "page"])
    chunks = numbered(split_pages(pages, SIZE, OVERLAP)).withColumn("metadata", F.parse_json("metadata"))
    m = F.col("metadata")
    return chunks.select(
        "source_file", "chunk_index", T.meta(m, "lang", "?").alias("lang"), T.meta(m, "size", "small").alias("size"), T.meta(m, "producer", "unknown").alias("producer"),
        F.try_variant_get(m, "$.own.id", "bigint").alias("doc_id"), T.label(T.meta(m, "source", "unknown"), T.meta(m, "size", "?"), F.col("chunk")).alias("block"),
    )


def _paged(docs: DataFrame) -> DataFrame:
    return positions(docs, "source_file", "doc_id", "page").select("source_file", F.col("page").cast("int").alias("page"), "metadata")


def prompt_template(spark: SparkSession, d: str) -> DataFrame:
    """A template with braces, a slot that comes twice, and characters that other engines take for their own, over turns that hold the like."""
    turns = table(spark, d, "conversations")
    said = F.concat("text", F.lit(" {question} {{x}} $1 \\2 %s"))
    return turns.select("conv_id", "turn", FORM.column(question=said, context=F.when(F.col("role") != "system", F.col("role"))).alias("prompt"))


#: The template of prompt_template.
FORM = Template("{{literal}} $1 \\1 {context}|{question}\n{{{context}}} %d")


def reversed_words(text: str) -> str:
    """A user's function: the words of a text from the last to the first."""
    return " ".join(reversed(text.split(" ")))


def chain_compose(spark: SparkSession, d: str) -> DataFrame:
    """A chain with a user's function in it: two branches over a question, a template, expressions around."""
    turned = passed() | reversed_words
    chain = record(context=turned | expression(lambda c: F.replace(c, F.lit(" "), F.lit("_"))), question=passed(), size=lifted(len, "long")) | Template("{size}: {question} / {context}") | expression(T.strip)
    rows = table(spark, d, "benchmark").select("item_id", "text")
    return chain.over(rows, "text", "answer").select("item_id", "answer")


def context_build(spark: SparkSession, d: str) -> DataFrame:
    return answering.contexts(_ranked(spark, d), _questions(spark, d).select("qid", "question")).select("qid", "context")


def context_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without a file (English) or a page (up to 1000 characters)."""
    rows = table(spark, d, "documents")
    file, page = F.when(F.col("lang") != "en", F.col("source")), F.when(F.col("n_chars") > 1000, F.col("doc_id").cast("int"))
    return rows.select("doc_id", T.label(file, page, F.col("text")).alias("block"))


def prompt(spark: SparkSession, d: str) -> DataFrame:
    found = answering.contexts(_ranked(spark, d), _questions(spark, d).select("qid", "question"))
    return answering.prompts(found).select("qid", "prompt")


def strip_think(spark: SparkSession, d: str) -> DataFrame:
    """All turns as answers wrapped in thoughts: closed, nested and unclosed ones, white space of several kinds around."""
    wrapped = F.concat(F.lit("\u00a0<think>why\n"), F.col("role"), F.lit("</think>\t\u2003"), F.col("text"), F.lit("<think>a<think>b</think>c</think> \n<think>open\u3000"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip_think(wrapped).alias("answer"))


def question_norm(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit(" \u2028\t"), F.array_join(F.split("text", " "), " "), F.lit("\u00a0\r\n\u200b"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.question(padded).alias("question"))


def question_filter(spark: SparkSession, d: str) -> DataFrame:
    """What each conversation would have asked, were its system turns blank and its fifth turn an exit word."""
    line = F.when(F.col("role") == "system", F.lit(" \u00a0")).when(F.col("turn") == 4, F.lit("  QUIT\n")).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", line.alias("text"))
    return answering.asked_questions(rows, "conv_id", "turn")


def question_stream(spark: SparkSession, d: str) -> DataFrame:
    """question_filter's rows by way of a stream: the lines are read as one, questions go to a log that holds each once."""
    at = scratch(spark, "questions")
    schema = table(spark, d, "conversations").schema
    turns = spark.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]")  # by a pattern, a stream takes a file as well as a folder
    line = F.when(F.col("role") == "system", F.lit(" \u00a0")).when(F.col("turn") == 4, F.lit("  QUIT\n")).otherwise(F.col("text"))
    log = QuestionLog(spark, f"{at}/log", 8)
    lines = turns.select(F.col("conv_id").cast("string").alias("session"), "turn", line.alias("text"))
    follow_questions(lines, log, f"{at}/checkpoint", lambda asked: asked.withColumn("answer", F.lit(None).cast("string")), once=True).awaitTermination()
    return log.answers.read().select(F.col("session").cast("long").alias("conv_id"), "turn", "question")


def model_missing(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a server: its turns are the models in its catalogue, as JSON, every third one without a tag. All need `user:2` to
    embed; those with an answer in them also need the chat model `system`. Names that only begin alike, or repeat, don't count."""
    turns = table(spark, d, "conversations")
    tagged = F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise(F.concat_ws(":", "role", F.col("turn").cast("string"), F.lit("q4")))
    catalogue = F.to_json(F.struct(F.collect_list(F.struct(tagged.alias("name"), "turn")).alias("models")))
    servers = turns.groupBy("conv_id").agg(catalogue.alias("catalogue"), F.bool_or(F.col("role") == "assistant").alias("asks"))
    installed = servers.select("conv_id", F.explode(answering.installed_models(F.col("catalogue"))).alias("name"))
    needed = answering.needed_models(servers.select("conv_id", "asks"), F.lit("user:2"), F.lit("system"), F.col("asks"))
    return answering.missing_models(needed, installed, "conv_id").select("conv_id", "priority", "model")


def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", F.explode(T.words(F.col("text"))).alias("w"))
    return rows.groupBy("item_id", T.hashed_bucket(F.col("w"), 768).alias("bucket")).agg(F.count("*").alias("n"))


def answer_stub(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from questions to cleaned answers, with the extractive generator."""
    found = answering.prompts(answering.contexts(_ranked(spark, d), _questions(spark, d).select("qid", "question")))
    return answering.cleaned(with_answers(found, FirstLineGenerator())).select("qid", "answer")


QUERIES = {
    f.__name__.rstrip("_"): f
    for f in (
        src_list, page_scan, chunk_full, chunk_small, chunk_lines, chunk_stats, chunk_index, chunk_id, chunk_id_missing_meta, batch_assign, ingest_report_, ingest_total_, upsert_merge, store_reset, cosine_pairs, topk_single,
        topk_batch, topk_collection, topk_short, context_build, context_defaults, prompt, strip_think, question_norm, question_filter, model_missing, embed_hash, answer_stub,
        topk_by_collection, topk_pruned, upsert_buckets, embed_reuse, chunk_metadata, prompt_template, chain_compose, question_stream,
    )
}


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{T.STRIP}', '', 'g')"


def _sql(text: str) -> str:
    """text as a SQL literal, characters past ASCII and control characters spelled out."""
    parts = ["''" if not text else ""]
    out, run = [], ""
    for c in text:
        if 32 <= ord(c) < 127:
            run += c.replace("'", "''")
        else:
            out += ([f"'{run}'"] if run else []) + [f"chr({ord(c)})"]
            run = ""
    out += [f"'{run}'"] if run else []
    return "(" + " || ".join(out or parts) + ")"


_PAGES = "pages_ AS (SELECT source AS source_file, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page, text AS page_content FROM documents)"

# Texts without blank lines, whose words are all shorter than a chunk: lines first, then the blanks of lines that are too long. Runs of
# short pieces and single long pieces are groups; in a group a chunk is a range [s, e) of pieces, found by running totals.
_CHUNKS = f"""
{_PAGES},
cut AS (
  SELECT source_file, page, CASE WHEN contains(page_content, chr(10)) THEN chr(10) ELSE ' ' END AS sep, page_content FROM pages_
), level1 AS (
  SELECT source_file, page, i, CASE WHEN i = 1 THEN '' ELSE sep END || string_split(page_content, sep)[i] AS piece
  FROM (SELECT *, unnest(range(1, len(string_split(page_content, sep)) + 1)) AS i FROM cut)
), marked AS (
  SELECT *, count(*) FILTER (length(piece) >= {SIZE}) OVER (PARTITION BY source_file, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longs FROM level1 WHERE piece <> ''
), level2 AS (
  SELECT source_file, page, 2 * longs AS g, i, 1 AS j, piece FROM marked WHERE length(piece) < {SIZE}
  UNION ALL
  SELECT source_file, page, 2 * longs + 1, i, j, CASE WHEN j = 1 THEN '' ELSE ' ' END || string_split(piece, ' ')[j]
  FROM (SELECT *, unnest(range(1, len(string_split(piece, ' ')) + 1)) AS j FROM marked WHERE length(piece) >= {SIZE})
), totals AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY source_file, page, g ORDER BY i, j) AS BIGINT) AS upto FROM level2 WHERE piece <> ''
), grouped AS (
  SELECT source_file, page, g, string_agg(piece, '' ORDER BY i, j) AS txt, list(upto ORDER BY i, j) AS cum FROM totals GROUP BY ALL
), ranges AS (
  SELECT source_file, page, g, txt, cum, 0 AS k, CAST(1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS base, len(list_filter(cum, lambda x: x <= {SIZE})) + 1 AS e FROM grouped
  UNION ALL
  SELECT source_file, page, g, txt, cum, k + 1, s2, base2, len(list_filter(cum, lambda x: x <= base2 + {SIZE})) + 1 FROM (
    SELECT *, CASE WHEN s2 = 1 THEN 0 ELSE cum[s2 - 1] END AS base2 FROM (
      SELECT *, greatest(s, CASE WHEN t <= 0 THEN 1 ELSE len(list_filter(cum, lambda x: x < t)) + 2 END) AS s2 FROM (
        SELECT *, greatest(cum[e - 1] - {OVERLAP}, cum[e] - {SIZE}) AS t FROM ranges WHERE e <= len(cum))))
), chunks_ AS (
  SELECT source_file, page, CAST(row_number() OVER (PARTITION BY source_file, page ORDER BY g, k) - 1 AS INTEGER) AS pos, chunk FROM (
    SELECT source_file, page, g, k, {_strip("substring(txt, base + 1, cum[e - 1] - base)")} AS chunk FROM ranges) WHERE chunk <> ''
), indexed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source_file ORDER BY page, pos) - 1 AS INTEGER) AS chunk_index FROM chunks_
), report AS (
  SELECT source_file, count(*) AS pages, (SELECT count(*) FROM chunks_ c WHERE c.source_file = p.source_file) AS chunks FROM pages_ p GROUP BY source_file
)"""

_QUESTIONS = f"""
questions AS (SELECT item_id AS qid, {_strip("text")} AS question FROM benchmark),
buckets AS (
  SELECT qid, CAST(CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % {DIM} AS INTEGER) AS bucket, count(*) AS n
  FROM (SELECT qid, unnest(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) AS w FROM questions) GROUP BY ALL
), asked AS (
  SELECT q.qid, q.question, list(coalesce(b.n, 0)::DOUBLE ORDER BY i) AS vector
  FROM questions q CROSS JOIN range({DIM}) r(i) LEFT JOIN buckets b ON b.qid = q.qid AND b.bucket = r.i GROUP BY ALL
), stored AS (SELECT vec_id AS id, label AS collection, embedding::DOUBLE[] AS embedding FROM embeddings),
pairs AS (SELECT qid, id, collection, list_cosine_distance(embedding, vector) AS distance FROM stored, asked),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance NULLS LAST, id) AS INTEGER) AS rank FROM pairs)"""

_CONTEXTS = f"""{_QUESTIONS},
contexts AS (
  SELECT q.qid, q.question, coalesce(string_agg('[' || d.source || ', page ' || d.doc_id || ']' || chr(10) || d.text, chr(10) || chr(10) ORDER BY r.rank), '') AS context
  FROM questions q LEFT JOIN (ranked r JOIN documents d ON d.doc_id = r.id AND r.rank <= {K}) ON r.qid = q.qid GROUP BY ALL
)"""

_MISSING = "CASE WHEN lang <> 'en' THEN source END", "CASE WHEN n_chars > 1000 THEN CAST(doc_id AS VARCHAR) END"
_WRAPPED = f"{_sql(chr(0xA0) + '<think>why' + chr(10))} || role || {_sql('</think>' + chr(9) + chr(0x2003))} || text || {_sql('<think>a<think>b</think>c</think> ' + chr(10) + '<think>open' + chr(0x3000))}"

_ASKED = f"""WITH lines AS (SELECT conv_id, turn, {_strip("CASE WHEN role = 'system' THEN ' ' || chr(160) WHEN turn = 4 THEN '  QUIT' || chr(10) ELSE text END")} AS question FROM conversations)
SELECT * FROM lines l WHERE question <> '' AND NOT EXISTS (SELECT 1 FROM lines s WHERE s.conv_id = l.conv_id AND s.turn <= l.turn AND lower(s.question) IN ('exit', 'quit'))"""

ORACLE_SQL = {
    "src_list": "SELECT DISTINCT '/corpus/' || source || '.pdf' AS path, source || '.pdf' AS source_file FROM documents",
    "page_scan": f"WITH {_PAGES} SELECT * FROM pages_",
    "chunk_full": f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks_",
    "chunk_small": f"WITH {_PAGES} SELECT source_file, page, CAST(0 AS INTEGER) AS pos, {_strip('page_content')} AS chunk FROM pages_ WHERE length(page_content) <= {SIZE} AND {_strip('page_content')} <> ''",
    "chunk_lines": f"WITH RECURSIVE {_CHUNKS} SELECT c.* FROM chunks_ c JOIN pages_ p USING (source_file, page) WHERE length(page_content) > {SIZE} AND list_max(list_transform(string_split(page_content, chr(10)), lambda x: length(x))) < {SIZE - 1}",
    "chunk_stats": f"WITH RECURSIVE {_CHUNKS} SELECT count(*) AS n_chunks, CAST(max(length(chunk)) AS INTEGER) AS longest, CAST(sum(length(chunk)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS not_in_page, CAST(0 AS BIGINT) AS not_stripped FROM chunks_",
    "chunk_index": f"WITH RECURSIVE {_CHUNKS} SELECT source_file, page, pos, chunk_index FROM indexed",
    "chunk_id": f"WITH RECURSIVE {_CHUNKS} SELECT source_file, chunk_index, sha256(source_file || '|' || page || '|' || chunk_index || '|' || chunk) AS id FROM indexed",
    "chunk_id_missing_meta": f"SELECT doc_id, sha256(coalesce({_MISSING[0]}, '') || '|' || coalesce({_MISSING[1]}, '') || '|0|' || text) AS id FROM documents",
    "batch_assign": f"WITH RECURSIVE {_CHUNKS} SELECT source_file, CAST(chunk_index // {BATCH} AS INTEGER) AS batch, min(chunk_index) AS first_index, max(chunk_index) AS last_index, count(*) AS n_chunks FROM indexed GROUP BY ALL",
    "ingest_report": f"WITH RECURSIVE {_CHUNKS} SELECT * FROM report",
    "ingest_total": f"WITH RECURSIVE {_CHUNKS} SELECT count(*) AS files, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(chunks) AS BIGINT) AS chunks FROM report",
    "upsert_merge": "SELECT 'doc-' || doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'edited: ' || text ELSE text END AS document FROM documents UNION ALL SELECT 'item-' || item_id, text FROM benchmark",
    "store_reset": "SELECT vec_id AS id, label AS collection FROM embeddings WHERE label IS DISTINCT FROM 1",
    "cosine_pairs": f"WITH {_QUESTIONS} SELECT qid, id, round(distance, 6) + 0.0 AS distance FROM pairs",
    "topk_single": f"WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM v ORDER BY id LIMIT 1), d AS (SELECT id, list_cosine_distance(e, qe) AS distance FROM v, q) SELECT CAST(row_number() OVER (ORDER BY greatest(distance, 0), id) AS INTEGER) AS rank, id, greatest(round(distance, 6), 0.0) + 0.0 AS distance FROM d ORDER BY distance, id LIMIT {K}",
    "topk_batch": f"WITH {_QUESTIONS} SELECT qid, rank, id, round(distance, 6) + 0.0 AS distance FROM ranked WHERE rank <= {K}",
    "topk_collection": f"WITH {_QUESTIONS}, own AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS place FROM pairs WHERE collection = 1) SELECT qid, place AS rank, id, round(distance, 6) + 0.0 AS distance FROM own WHERE place <= {K}",
    "topk_short": f"WITH {_QUESTIONS}, own AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS place FROM pairs WHERE collection = 0) SELECT q.qid, o.place AS rank, o.id, 0 AS collection FROM questions q LEFT JOIN own o USING (qid) UNION ALL SELECT qid, NULL, NULL, -1 FROM questions",
    "topk_by_collection": f"WITH {_QUESTIONS}, own AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS place FROM pairs WHERE collection = qid % 10) SELECT qid, place AS rank, id, round(distance, 6) + 0.0 AS distance FROM own WHERE place <= {K}",
    "topk_pruned": f"WITH {_QUESTIONS} SELECT qid, rank, id, round(distance, 6) + 0.0 AS distance FROM ranked WHERE rank <= {K}",
    "upsert_buckets": """WITH held AS (SELECT CAST(CAST('0x' || substring(md5('doc-' || doc_id), 1, 8) AS BIGINT) % 256 AS INTEGER) AS bucket, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS edited FROM documents)
SELECT bucket, count(*) AS rows, count(*) FILTER (WHERE edited) AS replaced FROM held GROUP BY bucket HAVING bool_or(edited)""",
    "embed_reuse": "SELECT source, count(*) AS texts, count(DISTINCT text) FILTER (WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')) AS embedded FROM documents GROUP BY source",
    "chunk_metadata": f"""WITH RECURSIVE {_CHUNKS}, docs AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, CASE WHEN n_chars > 1000 THEN CAST(n_chars AS VARCHAR) END AS size FROM documents)
SELECT source_file, chunk_index, lang, coalesce(size, 'small') AS size, 'unknown' AS producer, doc_id, '[' || source || ', page ' || coalesce(size, '?') || ']' || chr(10) || chunk AS block
FROM indexed i JOIN docs d ON d.source = i.source_file AND d.place = i.page""",
    "prompt_template": f"""WITH said AS (SELECT conv_id, turn, text || {_sql(" {question} {{x}} $1 " + chr(92) + "2 %s")} AS question, CASE WHEN role <> 'system' THEN role ELSE '' END AS context FROM conversations)
SELECT conv_id, turn, {_sql("{literal} $1 " + chr(92) + "1 ")} || context || '|' || question || {_sql(chr(10) + "{")} || context || {_sql("} %d")} AS prompt FROM said""",
    "chain_compose": f"SELECT item_id, {_strip("length(text) || ': ' || text || ' / ' || array_to_string(list_reverse(string_split(text, ' ')), '_')")} AS answer FROM benchmark",
    "context_build": f"WITH {_CONTEXTS} SELECT qid, context FROM contexts",
    "context_defaults": f"SELECT doc_id, '[' || coalesce({_MISSING[0]}, 'unknown') || ', page ' || coalesce({_MISSING[1]}, '?') || ']' || chr(10) || text AS block FROM documents",
    "prompt": f"WITH {_CONTEXTS} SELECT qid, {_sql(T.PROMPT_HEAD)} || context || {_sql(T.PROMPT_QUESTION)} || question || {_sql(T.PROMPT_END)} AS prompt FROM contexts",
    "strip_think": f"SELECT conv_id, turn, {_strip(f'regexp_replace({_WRAPPED}, {chr(39)}<think>.*?</think>{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}gs{chr(39)})')} AS answer FROM conversations",
    "question_norm": f"SELECT conv_id, turn, {_strip(_sql(' ' + chr(0x2028) + chr(9)) + ' || text || ' + _sql(chr(0xA0) + chr(13) + chr(10) + chr(0x200B)))} AS question FROM conversations",
    "question_filter": _ASKED,
    "question_stream": _ASKED,
    "model_missing": """WITH installed AS (SELECT conv_id, role || CASE WHEN turn % 3 = 0 THEN '' ELSE ':' || turn || ':q4' END AS name FROM conversations),
needed AS (SELECT DISTINCT conv_id, 'user:2' AS model, CAST(0 AS INTEGER) AS priority FROM conversations UNION SELECT conv_id, 'system', 1 FROM conversations WHERE role = 'assistant')
SELECT conv_id, priority, model FROM needed n WHERE NOT EXISTS (SELECT 1 FROM installed i WHERE i.conv_id = n.conv_id AND (i.name = n.model OR starts_with(i.name, n.model || ':')))""",
    "embed_hash": "SELECT item_id, CAST(CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 768 AS INTEGER) AS bucket, count(*) AS n FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM benchmark) GROUP BY ALL",
    "answer_stub": f"WITH {_CONTEXTS} SELECT qid, {_strip('CASE WHEN context = ' + chr(39) * 2 + ' THEN ' + chr(39) + 'The context does not hold the answer.' + chr(39) + ' ELSE string_split(context, chr(10))[2] END')} AS answer FROM contexts",
}
