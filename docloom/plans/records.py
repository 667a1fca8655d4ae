"""Queries over documents, sessions, uploads and owners that need no retrieval.

Customers stand for users, orders for their notebooks, line items for sources; events for requests and statuses.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions.text import UNSTABLE, is_normalized, nfc, normalized, sql_bare, sql_norm, sql_tokens
from docloom.operators import answers, evaluation, quality, segments, service, tenancy
from docloom.operators.chunk_store import ChunkStore
from docloom.operators.chunk_store import windows as chunk_store_windows
from docloom.operators.quality import FUNCTION_WORDS, LETTER_WORD
from docloom.plans.catalog import CHUNKS, DOCS, HEADINGS, _marked_up, norm_docs, query
from docloom.sources import extract, uploads
from docloom.sources.shared import fresh_path
from docloom.sources.tables import load, spread
from docloom.streaming import windows
from docloom.streaming.lifecycle import TRANSITIONS

# --- text and gate --------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, coalesce(text = {sql_norm()}, false) AS is_normalized FROM documents")
def normalized_flags(spark, sf):
    return normalized(load(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.coalesce(is_normalized(F.col("text"), F.col("norm")), F.lit(False)).alias("is_normalized"))


_ISSUES = """list_filter([CASE WHEN char_count = 0 THEN 'empty' END, CASE WHEN legacy_encoding = 'tcvn3' THEN 'legacy_tcvn3' END, CASE WHEN legacy_encoding = 'vni' THEN 'legacy_vni' END, CASE WHEN mojibake_ratio > 0.001 THEN 'mojibake' END,
    CASE WHEN replacement_ratio > 0 THEN 'replacement_chars' END, CASE WHEN html_entity_count > 3 THEN 'html_entities' END, CASE WHEN weird_alnum_ratio > 0.03 THEN 'mixed_alnum' END,
    CASE WHEN looks_vietnamese AND legacy_encoding IS NULL AND diacritic_ratio < 0.03 THEN 'lost_diacritics' END, CASE WHEN char_count > 0 AND letter_ratio < 0.35 THEN 'few_letters' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT doc_id, array_to_string({_ISSUES}, ',') AS issues FROM ({quality.SQL_SIGNALS})")
def quality_issues(spark, sf):
    return quality.assess(spread(load(spark, sf, "documents").select("doc_id", "text"))).select("doc_id", F.array_join("issues", ",").alias("issues"))


@query("""SELECT doc_id, round(coalesce(len(regexp_extract_all(text, '[À-ỹ]')) / nullif(length(text), 0)::DOUBLE, 0), 6) AS marked_ratio, round(coalesce((length(text) - length(replace(text, chr(65533), ''))) / nullif(length(text), 0)::DOUBLE, 0), 6) AS replaced_ratio,
    coalesce(text = nfc_normalize(text), true) AS is_nfc FROM documents""")
def raw_signals(spark, sf):
    """Shares of marked letters and of replacement characters in a raw text, and whether it is composed."""
    t = F.coalesce("text", F.lit(""))
    share = lambda n: F.round(F.coalesce(F.try_divide(n.cast("double"), F.char_length(t)), F.lit(0.0)), 6)
    docs = load(spark, sf, "documents").select("doc_id", "text")
    same = F.when(F.coalesce(F.col("text").rlike(UNSTABLE), F.lit(False)), nfc(F.when(F.col("text").rlike(UNSTABLE), F.col("text"))) == F.col("text")).otherwise(F.lit(True))
    return docs.select("doc_id", share(F.char_length(F.regexp_replace(t, "[^À-ỹ]+", ""))).alias("marked_ratio"), share(F.char_length(t) - F.char_length(F.translate(t, "�", ""))).alias("replaced_ratio"), same.alias("is_nfc"))


_VI = f"list_filter(regexp_extract_all(lower({sql_bare('t')}), '{LETTER_WORD}'), lambda w: list_contains({FUNCTION_WORDS}, w))"
_WORDS = f"regexp_extract_all(lower({sql_bare('t')}), '{LETTER_WORD}')"


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN len({_WORDS}) > 0 AND len({_VI}) >= len({_WORDS}) * 0.1 THEN 'vi' ELSE 'en' END AS language FROM d")
def answer_language(spark, sf):
    return norm_docs(spark, sf).select("doc_id", answers.answer_language(F.col("norm")).alias("language"))


@query("""WITH w AS (SELECT lang, text, unnest(range(0, length(text), 200)) AS i FROM documents WHERE length(text) > 0), p AS (SELECT lang, substring(text, i + 1, 200) AS a FROM w)
    SELECT lang, round(sum(levenshtein(a, replace(a, 'e', 'o'))) / sum(length(a))::DOUBLE, 6) AS cer, sum(length(a))::BIGINT AS chars FROM p GROUP BY lang""")
def engine_cer(spark, sf):
    """Errors in characters of whole texts that an engine reads with one letter for another."""
    rows = load(spark, sf, "documents").filter(F.char_length("text") > 0).select("lang", "text", F.translate("text", "e", "o").alias("read"))
    return evaluation.char_errors(rows, "text", "read", "lang").select("lang", F.round(F.col("errors") / F.col("chars"), 6).alias("cer"), "chars")


@query()
def engine_wer(spark, sf):
    """Errors in words of whole texts that an engine reads without the words of one or two letters."""
    rows = spread(load(spark, sf, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("read", F.regexp_replace("text", "(?<![^ \\n])[^ \\n]{1,2}(?![^ \\n])", ""))
    each = rows.select("lang", evaluation.word_errors(F.col("text"), F.col("read")).alias("errors"), F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")).alias("words"))
    return each.groupBy("lang").agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"))


# --- pages, uploads, chunks -----------------------------------------------------------------------------------------

_PAGES = f"{DOCS}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM d), pg AS (SELECT doc_id, CAST(i // 3 + 1 AS INTEGER) AS page, string_agg(x, chr(10) ORDER BY i) AS x FROM l GROUP BY ALL)"


def _pages(spark, sf):
    """Three lines of a document are a page."""
    lines = F.split("norm", "\n")
    page = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 3).cast("int")), lambda p: F.struct((p + 1).alias("page"), F.array_join(F.slice(lines, p * 3 + 1, 3), "\n").alias("text")))
    return norm_docs(spark, sf).select("doc_id", F.inline(page))


@query(f"WITH {_PAGES} SELECT doc_id, round(avg(CASE WHEN length(trim(x)) < 100 THEN 1 ELSE 0 END), 6) AS poor_share, avg(CASE WHEN length(trim(x)) < 100 THEN 1 ELSE 0 END) > 0.5 AS is_scanned FROM pg GROUP BY doc_id")
def scanned_documents(spark, sf):
    return extract.scanned(_pages(spark, sf)).select("doc_id", F.round("poor_share", 6).alias("poor_share"), "is_scanned")


_METHOD = "CASE WHEN length(trim(x)) >= 100 THEN 'text' WHEN coalesce(len(regexp_extract_all(x, '\\p{L}')) / nullif(length(x), 0)::DOUBLE, 0) >= 0.60 THEN 'fast' ELSE 'model' END"


@query(f"WITH {_PAGES} SELECT doc_id, page, {_METHOD} AS method, CASE WHEN length(trim(x)) < 10 THEN 'NEAR_EMPTY' END AS warning FROM pg")
def page_routing(spark, sf):
    """How each page is read, and warnings of pages with almost nothing; the share of letters stands for an engine's score."""
    pages = _pages(spark, sf)
    letters = F.coalesce(F.try_divide(F.char_length(F.regexp_replace("text", "\\P{L}+", "")).cast("double"), F.char_length("text")), F.lit(0.0))
    return pages.select("doc_id", "page", uploads.page_method(F.char_length(F.trim("text")), letters).alias("method"), uploads.page_warning(F.col("text")).alias("warning"))


@query(f"WITH {_PAGES}, k AS (SELECT {_METHOD} AS method FROM pg) SELECT method, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM k GROUP BY method")
def page_tiers(spark, sf):
    return evaluation.shares(page_routing(spark, sf), "method")


_EXT = ["pdf", "docx", "TXT", "md", "png", "jpg", "exe", "webp"]


@query(f"""WITH u AS (SELECT doc_id AS upload_id, source AS notebook_id, {_EXT}[doc_id % 8 + 1] AS ext, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents),
    e AS (SELECT *, CASE WHEN lower(ext) = 'exe' THEN 'EXTENSION' WHEN bytes > CASE WHEN ext IN ('png', 'jpg', 'webp') THEN 2000 ELSE 6000 END THEN 'TOO_LARGE' WHEN bytes = 0 THEN 'EMPTY' END AS err FROM u),
    n AS (SELECT *, count(*) FILTER (err IS NULL) OVER (PARTITION BY notebook_id ORDER BY upload_id) AS k FROM e)
    SELECT upload_id, notebook_id, bytes, coalesce(err, CASE WHEN k > 20 THEN 'TOO_MANY' END) AS error_code FROM n""")
def upload_validation(spark, sf):
    """Documents as uploads to their source, with names of eight kinds and small limits."""
    name = F.concat(F.lit("file."), F.get(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 8).cast("int")))
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("upload_id"), F.col("source").alias("notebook_id"), name.alias("name"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return uploads.validated(rows, most=20, max_bytes=6000, max_image=2000).select("upload_id", "notebook_id", "bytes", "error_code")


@query("""SELECT page_id, url, CASE WHEN html IS NULL THEN 'missing' WHEN NOT starts_with(html, '<!DOCTYPE') THEN 'bad_magic' WHEN strlen(html) < 2000 THEN 'too_small' ELSE 'ok' END AS status, CAST(strlen(html) AS BIGINT) AS bytes FROM pages""")
def download_manifest(spark, sf):
    """A list of downloads with what became of each, written as CSV and read back."""
    rows = load(spark, sf, "pages").select("page_id", "url", uploads.download_status(F.col("html"), "<!DOCTYPE", 2000).alias("status"), F.octet_length("html").cast("long").alias("bytes"))
    path = fresh_path(spark, "manifest")
    uploads.write_manifest(rows, path)
    return uploads.read_manifest(spark, path, "page_id long, url string, status string, bytes long")


@query("SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN 'lookup' ELSE 'summary' END AS kind FROM benchmark")
def question_set(spark, sf):
    """Questions with their kind, written as JSON lines and read back."""
    rows = load(spark, sf, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 == 0, "lookup").otherwise("summary").alias("kind"))
    path = fresh_path(spark, "questions")
    uploads.write_questions(rows, path)
    return uploads.read_questions(spark, path, "item_id long, text string, kind string")


_SECTIONS = HEADINGS.replace("d AS (SELECT doc_id, source", "d0 AS (SELECT doc_id, source").replace("FROM d)", "FROM d0)")
_SECTIONS = f"""{_SECTIONS},
    b AS (SELECT doc_id, 0 AS pos FROM d0 UNION SELECT doc_id, pos FROM h), s AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM b),
    x AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM m GROUP BY doc_id),
    d AS (SELECT doc_id * 10000000 + pos AS doc_id, substring(t, pos + 1, coalesce(nxt, length(t)) - pos) AS t FROM s JOIN x USING (doc_id) WHERE substring(t, pos + 1, coalesce(nxt, length(t)) - pos) <> '')"""
_PATHS = """a AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level = 2 THEN pos END) OVER w AS p2, max(CASE WHEN level = 3 THEN pos END) OVER w AS p3 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    paths AS (SELECT a.doc_id, a.pos, concat_ws(' > ', h1.title, CASE WHEN p2 > coalesce(p1, -1) THEN h2.title END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN h3.title END) AS path
    FROM a LEFT JOIN h h1 ON a.doc_id = h1.doc_id AND a.p1 = h1.pos LEFT JOIN h h2 ON a.doc_id = h2.doc_id AND a.p2 = h2.pos LEFT JOIN h h3 ON a.doc_id = h3.doc_id AND a.p3 = h3.pos)"""


@query(f"""WITH RECURSIVE {CHUNKS.replace(DOCS, _SECTIONS)}, {_PATHS},
    placed AS (SELECT doc_id // 10000000 AS doc_id, doc_id % 10000000 AS pos, chunk_index AS k, char_start, content FROM chunks)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS INTEGER) AS chunk_index, CAST(pos + char_start AS INTEGER) AS char_start, {sql_tokens('content')} AS token_count, md5(content) AS digest, path AS heading_path
    FROM placed LEFT JOIN paths USING (doc_id, pos)""")
def chunks_by_heading(spark, sf):
    """Greedy chunks that begin anew at every heading, with their path."""
    c = segments.chunks(_marked_up(spark, sf))
    return c.select("doc_id", "chunk_index", "char_start", "token_count", F.md5(F.col("content").cast("binary")).alias("digest"), "heading_path")


def _assembled(spark, sf):
    """Lines as blocks of pages of three, each with a box."""
    lines = norm_docs(spark, sf).select("doc_id", F.posexplode(F.split("norm", "\n")).alias("block_no", "text"))
    page, y = (F.floor(F.col("block_no") / 3) + 1).cast("int"), F.col("block_no").cast("double")
    box = F.struct(page.alias("page"), F.lit(72.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 1).alias("y1"))
    return extract.assemble(lines.select("doc_id", page.alias("page"), "block_no", "text", box.alias("bbox")))


_ASSEMBLED = f"""{DOCS.replace("d AS (", "d0 AS (", 1)},
    l0 AS (SELECT doc_id, trim(unnest(string_split(t, chr(10))), ' ' || chr(9) || chr(10)) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM d0),
    l1 AS (SELECT *, CAST(i // 3 + 1 AS INTEGER) AS page, max(x <> '') OVER p AS has, row_number() OVER (p ORDER BY i) AS k FROM l0 WINDOW p AS (PARTITION BY doc_id, i // 3)),
    bl AS (SELECT doc_id, i, page, x, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - 1 AS s, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e FROM l1 WHERE x <> '' OR (NOT has AND k = 1)),
    d AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) || chr(10) AS t FROM bl GROUP BY doc_id)"""


@query(f"""WITH RECURSIVE {CHUNKS.replace(DOCS, _ASSEMBLED)}, cs AS (SELECT doc_id, chunk_index, char_start, CAST(char_start + length(content) AS INTEGER) AS char_end FROM chunks),
    hit AS (SELECT c.doc_id, c.chunk_index, b.i, b.s FROM cs c JOIN bl b ON b.doc_id = c.doc_id AND b.x <> '' AND b.s < c.char_end AND b.e > c.char_start),
    bx AS (SELECT doc_id, chunk_index, CAST(count(*) AS INTEGER) AS boxes, CAST(arg_min(i, s) AS INTEGER) AS first_block FROM hit GROUP BY ALL),
    pg AS (SELECT c.doc_id, c.chunk_index, arg_max(b.page, b.s) AS page_no FROM cs c JOIN bl b ON b.doc_id = c.doc_id AND b.s <= c.char_start GROUP BY ALL)
    SELECT doc_id, chunk_index, char_start, char_end, page_no, coalesce(boxes, 0) AS boxes, first_block FROM cs JOIN pg USING (doc_id, chunk_index) LEFT JOIN bx USING (doc_id, chunk_index)""")
def document_chunks(spark, sf):
    """Chunks of assembled documents with the page on which they begin and the boxes that they overlap."""
    made = segments.chunk_document(_assembled(spark, sf))
    return made.select("doc_id", "chunk_index", "char_start", "char_end", "page_no", F.size("bbox").alias("boxes"), F.get("bbox", F.lit(0))["y0"].cast("int").alias("first_block"))


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM d)
    SELECT doc_id, CAST(i AS INTEGER) AS block_no, CAST(strpos(x, 'the') AS INTEGER) AS at, round(i * 1.23456::DOUBLE, 2) AS y0 FROM l WHERE contains(x, 'the')""")
def phrase_boxes(spark, sf):
    """The blocks that hold a phrase, where in them, and their tops to two places."""
    lines = norm_docs(spark, sf).select("doc_id", F.posexplode(F.split("norm", "\n")).alias("block_no", "x"))
    return lines.filter(F.contains("x", F.lit("the"))).select("doc_id", "block_no", F.instr("x", "the").alias("at"), F.round(F.col("block_no") * F.lit(1.23456), 2).alias("y0"))


_FIXED = "unnest(range(0, greatest(1, length(t)), 680)) AS a"


@query(f"""WITH {DOCS}, e AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN translate(left(t, 100), 'e', 'o') || substring(t, 101) || ' end' ELSE t END AS t FROM d),
    o AS (SELECT doc_id, a, substring(t, a + 1, 800) AS x FROM (SELECT doc_id, t, {_FIXED} FROM d)), n AS (SELECT doc_id, a, substring(t, a + 1, 800) AS x FROM (SELECT doc_id, t, {_FIXED} FROM e))
    SELECT doc_id, CAST(a AS INTEGER) AS char_start, md5(x) AS digest FROM (SELECT * FROM n WHERE x <> '' EXCEPT SELECT * FROM o)""")
def rechunk_changes(spark, sf):
    """Chunks that have to be made anew after every tenth document was edited."""
    docs = norm_docs(spark, sf)
    edit = F.concat(F.translate(F.substring("norm", 1, 100), "e", "o"), F.expr("substring(norm, 101)"), F.lit(" end"))
    edited = docs.withColumn("norm", F.when(F.col("doc_id") % 10 == 0, edit).otherwise(F.col("norm")))
    new = tenancy.changed_chunks(segments.fixed_chunks(edited), segments.fixed_chunks(docs))
    return new.select("doc_id", "char_start", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"WITH {DOCS}, o AS (SELECT doc_id, substring(t, a + 1, 800) AS x FROM (SELECT doc_id, t, {_FIXED} FROM d)) SELECT doc_id, count(*) AS chunks FROM o WHERE x <> '' GROUP BY doc_id")
def chunk_store(spark, sf):
    """Chunks stored twice: the second time writes nothing."""
    store = ChunkStore(spark, fresh_path(spark, "chunks"), cut=lambda t: segments.section_array(t, False), make=chunk_store_windows)
    for _ in range(2):
        store.put(norm_docs(spark, sf))
    return store.chunks().groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query(f"""WITH {_PAGES}, p AS (SELECT doc_id, count(*) AS pages FROM pg GROUP BY doc_id), c AS (SELECT doc_id, len(range(0, greatest(1, length(t)), 680)) AS chunks FROM d WHERE t <> '')
    SELECT doc_id, to_json({{'type': 'ready', 'doc_id': doc_id, 'page_count': pages, 'chunk_count': chunks}}) AS event FROM p JOIN c USING (doc_id)""")
def ready_events(spark, sf):
    """An event of each source that has been taken in: its pages and chunks."""
    pages = _pages(spark, sf).groupBy("doc_id").agg(F.count("*").alias("page_count"))
    chunks = segments.fixed_chunks(norm_docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return pages.join(chunks, "doc_id").select("doc_id", answers.event("ready", "doc_id", "page_count", "chunk_count").alias("event"))


# --- sessions ---------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT conv_id, turn, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || role || ' (p. ' || (turn + 1) || ')' || chr(10) || '«|CHUNK|»' || replace(coalesce(text, ''), '«|CHUNK|»', '') || '«|CHUNK|»' AS block FROM conversations)
    SELECT conv_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY turn)) AS digest FROM b GROUP BY conv_id""")
def context_blocks(spark, sf):
    c = load(spark, sf, "conversations").withColumn("page", F.col("turn") + 1)
    return answers.context_blocks(c, ["conv_id"], "turn", "role", "page", "text").select("conv_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN doc_id % 4 <> 0 THEN source || ' ' || lang END, coalesce(text, ''))) AS digest FROM documents")
def contextual_prefix(spark, sf):
    prefix = F.when(F.col("doc_id") % 4 != 0, F.concat("source", F.lit(" "), "lang"))
    return load(spark, sf, "documents").select("doc_id", F.md5(answers.with_prefix(prefix, F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


@query("""SELECT conv_id, trim(substring(regexp_replace(arg_min(text, turn), '[ \\t\\n]+', ' ', 'g'), 1, 60)) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def session_titles(spark, sf):
    return answers.session_titles(load(spark, sf, "conversations"))


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(text, '{rule.replace('(?i)', '')}', 'i') THEN '{name}'" for name, rule in answers.INTENTS) + " ELSE 'chat' END"


@query(f"WITH k AS (SELECT {_INTENT} AS intent FROM conversations WHERE role = 'user') SELECT intent, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM k GROUP BY intent")
def intent_shares(spark, sf):
    return evaluation.shares(load(spark, sf, "conversations").filter("role = 'user'").select(answers.intent(F.col("text")).alias("intent")), "intent")


@query("""WITH a AS (SELECT conv_id, turn, list_filter(string_split(text || ' [1]' || chr(10) || 'no source', chr(10)), lambda p: trim(p) <> '') AS p FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, round(len(list_filter(p, lambda x: regexp_matches(x, '\\[[0-9]+\\]'))) / nullif(len(p), 0)::DOUBLE, 6) AS coverage FROM a""")
def citation_coverage(spark, sf):
    """Answers whose next to last line carries a marker."""
    rows = load(spark, sf, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", F.round(answers.citation_coverage(F.concat("text", F.lit(" [1]\nno source"))), 6).alias("coverage"))


@query("SELECT conv_id, md5('# Session ' || conv_id || chr(10) || chr(10) || string_agg('**' || role || '**: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def session_export(spark, sf):
    return answers.exported(load(spark, sf, "conversations")).select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, to_json({'type': 'status', 'conv_id': conv_id, 'turn': turn, 'role': role}) AS event FROM conversations")
def answer_events(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", answers.event("status", "conv_id", "turn", "role").alias("event"))


# --- owners, links, totals --------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = e.event_id AND o.o_custkey % 20 = e.user_id % 20) THEN 'ok' ELSE 'not_found' END AS status FROM events e""")
def tenant_isolation(spark, sf):
    """Requests for the notebook of their number; twenty owners share all of them."""
    notebooks = load(spark, sf, "orders").select(F.col("o_orderkey").alias("notebook_id"), (F.col("o_custkey") % 20).alias("user_id"))
    asked = load(spark, sf, "events").select("event_id", F.col("event_id").alias("notebook_id"), (F.col("user_id") % 20).alias("user_id"))
    ok = tenancy.visible(asked, notebooks).select("event_id", F.lit("ok").alias("found"))
    return asked.join(ok, "event_id", "left").select("event_id", F.coalesce("found", F.lit("not_found")).alias("status"))


@query("""SELECT e.event_id, o.o_orderkey AS notebook_id FROM events e JOIN orders o ON md5(CAST(o.o_orderkey AS VARCHAR)) = md5(CAST(e.user_id AS VARCHAR)) WHERE o.o_orderkey % 4 <> 1 AND o.o_orderstatus <> 'F'""")
def shared_links(spark, sf):
    """Opened links; those of finished orders are revoked."""
    token = lambda c: F.md5(F.col(c).cast("string").cast("binary")).alias("token")
    links = load(spark, sf, "orders").filter("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("notebook_id"), token("o_orderkey"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"))
    return tenancy.opened(load(spark, sf, "events").select("event_id", token("user_id")), links).select("event_id", "notebook_id")


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g))
    SELECT o_orderstatus AS status, count(*) AS sources FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY ALL""")
def cascade_delete(spark, sf):
    """Sources that are left, by their notebook's status, when users with debts are deleted."""
    gone = load(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lost = orders.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    left = tenancy.cascade(load(spark, sf, "lineitem").select("l_orderkey"), lost, "l_orderkey")
    return left.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("sources"))


@query(f"""WITH {DOCS}, c AS (SELECT doc_id * 1000 + i AS chunk_id, doc_id AS source_id, x FROM (SELECT doc_id, i, substring(t, i * 680 + 1, 800) AS x FROM d, (SELECT unnest(range(0, 4)) AS i)) WHERE x <> '')
    SELECT v.conv_id, v.turn, c.source_id, s.source AS title, md5(c.x) AS digest FROM conversations v JOIN c ON c.chunk_id = v.conv_id * 1000 + v.turn % 4 JOIN documents s ON s.doc_id = c.source_id""")
def citation_hydrate(spark, sf):
    """Each turn cites a chunk of the document of its conversation's number."""
    made = segments.fixed_chunks(norm_docs(spark, sf)).filter("char_start < 2720")
    chunks = made.select((F.col("doc_id") * 1000 + F.floor(F.col("char_start") / 680)).alias("chunk_id"), F.col("doc_id").alias("source_id"), F.md5(F.col("content").cast("binary")).alias("digest"))
    cited = load(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn") % 4).alias("chunk_id"))
    sources = load(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("title"))
    return tenancy.hydrated(cited, chunks, sources).select("conv_id", "turn", "source_id", "title", "digest")


@query("""SELECT (SELECT count(*) FROM orders) AS notebooks, (SELECT count(*) FROM lineitem) AS sources, (SELECT count(DISTINCT c_custkey) FROM customer) AS users, (SELECT sum(strlen(coalesce(text, '')))::BIGINT FROM documents) AS bytes""")
def system_totals(spark, sf):
    count = lambda table, c, k: load(spark, sf, table).agg(c.alias("n")).select(F.lit(k).alias("k"), "n")
    rows = count("orders", F.count("*"), "notebooks").union(count("lineitem", F.count("*"), "sources")).union(count("customer", F.countDistinct("c_custkey"), "users"))
    rows = rows.union(count("documents", F.sum(F.octet_length(F.coalesce("text", F.lit("")))), "bytes"))
    return rows.groupBy().pivot("k", ["notebooks", "sources", "users", "bytes"]).agg(F.first("n"))


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS calls, count(*) FILTER (event_type = 'view') AS saved, round(avg(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 6) AS hit_ratio FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def cache_ratios(spark, sf):
    """Views stand for answers from the cache."""
    calls = load(spark, sf, "events").filter("event_type <> 'error'")
    hit = F.col("event_type") == "view"
    return calls.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.count_if(hit).alias("saved"), tenancy.ratio(hit).alias("hit_ratio"))


@query("""WITH c AS (SELECT vec_id AS cache_id, vec_id % 5 AS hit_count, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(vec_id % 40 AS INTEGER) AS expires_at FROM embeddings),
    h AS (SELECT user_id AS cache_id, count(*) AS n FROM events GROUP BY user_id)
    SELECT cache_id, hit_count + coalesce(n, 0) AS hit_count FROM c LEFT JOIN h USING (cache_id) WHERE expires_at > TIMESTAMP '2024-01-20 00:00:00'""")
def cache_hits(spark, sf):
    """Unexpired entries with their hits; a user's events hit the entry of the user's number."""
    expires = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("vec_id") % 40).cast("int"))
    cache = load(spark, sf, "embeddings").select(F.col("vec_id").alias("cache_id"), (F.col("vec_id") % 5).alias("hit_count"), expires.alias("expires_at"))
    return service.counted_hits(service.live(cache, "2024-01-20"), load(spark, sf, "events").select(F.col("user_id").alias("cache_id"))).select("cache_id", "hit_count")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'chunking' WHEN 'purchase' THEN 'embedding' ELSE 'failed' END AS status FROM events),
    b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e)
    SELECT event_id, status, before, coalesce(CASE coalesce(before, '') WHEN '' THEN status = 'queued' WHEN 'queued' THEN status IN ('parsing', 'failed') WHEN 'parsing' THEN status IN ('ocr', 'chunking', 'failed') WHEN 'ocr' THEN status IN ('chunking', 'failed')
        WHEN 'chunking' THEN status IN ('embedding', 'failed') WHEN 'embedding' THEN status IN ('ready', 'failed') ELSE status = 'queued' END, false) AS valid FROM b""")
def status_transitions(spark, sf):
    """Events as statuses of a source for each user: which may follow the one before."""
    names = F.create_map(*[F.lit(x) for x in ("signup", "queued", "view", "parsing", "click", "chunking", "purchase", "embedding", "error", "failed")])
    rows = load(spark, sf, "events").select(F.col("user_id").alias("source_id"), "event_id", F.col("ts").alias("at"), names[F.col("event_type")].alias("status"))
    return service.transitions(rows, TRANSITIONS).select("event_id", "status", "before", "valid")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events QUALIFY place <= 10")
def newest_first(spark, sf):
    """The ten newest rows of each user, the newest first."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return load(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).alias("place")).filter("place <= 10")


@query(f"SELECT lang, count(*) AS n, round(avg(CASE WHEN (l.quality = 1) = (q.route = 'index') THEN 1 ELSE 0 END), 6) AS agreement FROM labels l JOIN ({quality.SQL_ASSESS}) q USING (doc_id) JOIN documents d USING (doc_id) GROUP BY lang")
def judge_agreement(spark, sf):
    """How often the gate and the labels agree on a document."""
    graded = quality.assess(spread(load(spark, sf, "documents").select("doc_id", "text", "lang")), keep=("lang",))
    both = load(spark, sf, "labels").join(graded, "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n"), tenancy.ratio((F.col("quality") == 1) == (F.col("route") == "index")).alias("agreement"))


@query("""WITH f AS (SELECT user_id, date_trunc('minute', ts) AS m FROM events WHERE event_type = 'error'), w AS (SELECT user_id, m - INTERVAL 1 MINUTE * CAST(k AS INTEGER) AS window_start FROM f, (SELECT unnest(range(0, 5)) AS k))
    SELECT user_id, window_start, count(*) AS failures FROM w GROUP BY ALL""")
def failure_windows(spark, sf):
    """Failures in windows of five minutes that begin every minute, as a stream read to its end."""
    counts = windows.failure_stream(windows.table_stream(spark, sf, "events").filter("event_type = 'error'"))
    return windows.to_end(counts.select("user_id", F.col("window.start").alias("window_start"), "failures"))
