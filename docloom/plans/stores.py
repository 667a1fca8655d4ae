"""Queries over what the library stores and streams: cells of vectors, the inverted index, versioned chunks, keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import compounds, legacy, tables
from docloom.functions.text import lexemes, normalized, sql_bare, sql_norm
from docloom.operators import answers, evaluation, inverted, nearest, quality, retrieval
from docloom.operators.chunk_store import ChunkStore
from docloom.plans.catalog import DOCS, POSTINGS, VECTOR, _marked_up, _terms, norm_docs, query
from docloom.plans.catalog import ORACLE_SQL as SQL
from docloom.plans.catalog import QUERIES
from docloom.plans.hybrid import DENSE
from docloom.plans.records import _PAGES
from docloom.sources import extract, registry
from docloom.sources.shared import fresh_path, stored
from docloom.sources.tables import load, spread
from docloom.streaming import expiry, lifecycle, sinks, windows

# --- vectors by cell ------------------------------------------------------------------------------------------------


def _cells(spark, sf, scoped):
    v = load(spark, sf, "embeddings")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("q_label"))
    return nearest.search(nearest.build(v, fresh_path(spark, "cells")), asked, 50, [("label", "q_label")] if scoped else [], [("vec_id", "query_id")])


@query(f"WITH {VECTOR} SELECT query_id, vec_id, score, rnk FROM vt")
def vector_topk_cells(spark, sf):
    """The rows of vector_topk from vectors stored by cell, each question until its results are proven."""
    return _cells(spark, sf, scoped=False)


@query(SQL["vector_topk_scoped"])
def vector_topk_scoped_cells(spark, sf):
    """The rows of vector_topk_scoped: a thin scope makes a question probe on, so it never returns too few."""
    return _cells(spark, sf, scoped=True)


# --- the stored index of words --------------------------------------------------------------------------------------


def _index(spark, sf):
    path = fresh_path(spark, "index")
    inverted.build(norm_docs(spark, sf), path)
    return inverted.Stored(spark, path)


@query(f"WITH {POSTINGS} SELECT lexeme, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM ix GROUP BY lexeme")
def lexicon_counts(spark, sf):
    """How many documents hold each lexeme, from the index's counts."""
    return _index(spark, sf).counts()


@query(f"WITH {DENSE} SELECT query_id, doc_id, score, rnk FROM kb")
def keyword_density_stored(spark, sf):
    """The rows of keyword_density from the buckets of the asked lexemes."""
    terms = _terms(spark, sf)
    return retrieval.top(retrieval.cover_density(terms, None, places=_index(spark, sf).occurrences(terms)), "query_id", "doc_id")


@query(f"""WITH {POSTINGS}, q AS (SELECT item_id, regexp_extract_all(lower({sql_bare(sql_norm())}), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
    terms AS (SELECT item_id AS query_id, unnest(range(len(w))) AS ordinal, unnest(w) AS lexeme, len(w) AS length FROM q),
    hits AS (SELECT query_id, length, doc_id, pos - ordinal AS at FROM ix JOIN terms USING (lexeme) GROUP BY ALL HAVING count(*) = length)
    SELECT query_id, doc_id, count(*) AS occurrences, CAST(min("at") AS INTEGER) AS first_at FROM hits GROUP BY ALL""")
def passage_match(spark, sf):
    """Where all words of a question stand next to each other: every word is asked for, whatever their number."""
    words = normalized(load(spark, sf, "benchmark")).select(F.col("item_id").alias("query_id"), F.lit(0).alias("part"), lexemes(F.col("norm")).alias("w"))
    terms = words.select("query_id", "part", F.size("w").alias("length"), F.posexplode("w").alias("ordinal", "lexeme"))
    found = _index(spark, sf).occurrences(terms)
    return found.groupBy("query_id", "doc_id").agg(F.count("*").alias("occurrences"), F.min("at").cast("int").alias("first_at"))


# --- versioned chunks -----------------------------------------------------------------------------------------------


@query(SQL["chunks_by_heading"])
def chunk_store_versions(spark, sf):
    """Chunks of edited documents, then of the edited ones as they are, one removed and stored again: what is left is chunks_by_heading."""
    docs = _marked_up(spark, sf)
    edited = docs.withColumn("norm", F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("norm"), F.lit("\n# Added\nnew"))).otherwise(F.col("norm")))
    store = ChunkStore(spark, fresh_path(spark, "chunks"))
    store.put(edited)
    store.put(docs.filter("doc_id % 10 = 0"))
    store.remove(docs.filter("doc_id % 50 = 1").select("doc_id"))
    store.put(docs.filter("doc_id % 50 = 1"))
    c = store.chunks()
    return c.select("doc_id", "chunk_index", "char_start", "token_count", F.md5(F.col("content").cast("binary")).alias("digest"), "heading_path")


# --- keyed state ----------------------------------------------------------------------------------------------------


@query(SQL["status_transitions"])
def lifecycle_stream(spark, sf):
    """status_transitions as a stream with keyed state, read to its end."""
    names = F.create_map(*[F.lit(x) for x in ("signup", "queued", "view", "parsing", "click", "chunking", "purchase", "embedding", "error", "failed")])
    events = windows.table_stream(spark, sf, "events").select(F.col("user_id").alias("source_id"), "event_id", F.col("ts").alias("at"), names[F.col("event_type")].alias("status"))
    out = lifecycle.lifecycle(events, None)
    return sinks.to_end(out, fresh_path(spark, "lifecycle")).select("event_id", "status", "before", "valid")


def _json(kind: str, **fields: str) -> str:
    return "to_json({" + ", ".join([f"'type': '{kind}'", *[f"'{k}': {v}" for k, v in fields.items()]]) + "})"


_STATUS = ", ".join(
    f"CASE WHEN {'true' if s in ('queued', 'parsing') else 'is_scanned AND ok' if s == 'ocr' else 'ok'} THEN {_json('source_status', source_id='doc_id', status=repr(s), progress=str(p), stage_label_key=repr(k))} END"
    for s, (p, k) in sinks.STAGES.items() if s != "ready"
)


@query(f"""WITH {_PAGES}, p AS (SELECT doc_id, count(*) AS pages, avg(CASE WHEN length(trim(x)) < 100 THEN 1 ELSE 0 END) > 0.5 AS is_scanned FROM pg GROUP BY doc_id),
    s AS (SELECT doc_id, pages, is_scanned, t <> '' AS ok, CASE WHEN t <> '' THEN len(range(0, length(t), 680)) ELSE 0 END AS chunks FROM d JOIN p USING (doc_id)),
    e AS (SELECT doc_id, list_filter([{_STATUS}, CASE WHEN ok THEN {_json('source_ready', source_id='doc_id', page_count='pages', chunk_count='chunks')} END,
        CASE WHEN NOT ok THEN {_json('source_failed', source_id='doc_id', error_code="'TEXT_EMPTY'", error_message="'error.text_empty'")} END], lambda x: x IS NOT NULL) AS ev FROM s)
    SELECT doc_id, CAST(generate_subscripts(ev, 1) - 1 AS INTEGER) AS no, unnest(ev)::VARCHAR AS event FROM e""")
def progress_stream(spark, sf):
    """Progress events of documents as they stream in, through a sink that counts each epoch once."""
    stream = windows.table_stream(spark, sf, "documents").select("doc_id", "text")

    def make(batch):
        lines = F.split("norm", "\n")
        page = lambda k: F.array_join(F.slice("_l", k * 3 + 1, 3), "\n")
        docs = normalized(batch).withColumn("_l", lines).withColumn("_p", F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / 3).cast("int")), page))
        poor = F.size(F.filter("_p", lambda x: F.char_length(F.trim(x)) < extract.SCAN_CHARS)) / F.size("_p")
        chunks = F.ceil(F.char_length("norm") / 680).cast("long")
        error = F.when(F.col("norm") == "", "TEXT_EMPTY")
        return sinks.progress_events(docs.select("doc_id", error.alias("error_code"), (poor > extract.SCAN_SHARE).alias("ocr"), F.size("_p").alias("page_count"), chunks.alias("chunk_count")).withColumnRenamed("doc_id", "source_id")).withColumnRenamed("source_id", "doc_id")

    schema = "doc_id long, no int, event string"
    return sinks.to_end(stream, fresh_path(spark, "progress"), make=make, schema=sinks.T.StructType.fromDDL(schema))


TTL = 1440  # minutes that an entry lives in the queries


def _cache_rows(events):
    return events.select(F.col("user_id").alias("key"), "event_id", F.col("event_type").isin("signup", "purchase").alias("put"), F.col("ts").alias("at")).filter("key is not null")


@query(f"""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, event_type IN ('signup', 'purchase') AS put, epoch_us(ts) AS us FROM events),
    h AS (SELECT *, last_value(CASE WHEN put THEN event_id END IGNORE NULLS) OVER b AS held, last_value(CASE WHEN put THEN us END IGNORE NULLS) OVER b AS held_us FROM r WINDOW b AS (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT *, held IS NOT NULL AND us < held_us + {TTL * 60_000_000} AS alive FROM h),
    p AS (SELECT key, event_id AS entry_id, us + {TTL * 60_000_000} AS ends, lead(us) OVER (PARTITION BY key ORDER BY us, event_id) AS replaced FROM r WHERE put),
    m AS (SELECT key, max(us) AS last FROM r GROUP BY key), w AS (SELECT (max(us) // 1000 - 60000) * 1000 AS mark FROM r)
    SELECT key, event_id, CASE WHEN put THEN 'stored' WHEN alive THEN 'hit' ELSE 'miss' END AS kind, CASE WHEN put THEN event_id WHEN alive THEN held END AS entry_id, us FROM e
    UNION ALL SELECT key, NULL, 'expired', entry_id, ends FROM p JOIN m USING (key), w WHERE CASE WHEN replaced IS NULL THEN ends <= greatest(last, mark) ELSE replaced >= ends END""")
def cache_expiry_stream(spark, sf):
    """Signups and purchases store an answer of their user, other events ask for it: hits, misses and expiries of a day."""
    out = expiry.cache_stream(_cache_rows(windows.table_stream(spark, sf, "events")), TTL)
    return sinks.to_end(out, fresh_path(spark, "expiry"))


# --- table functions, old codes, compounds ---------------------------------------------------------------------------


@query(SQL["sentences"])
def sentences_sql(spark, sf):
    """The rows of sentences from an SQL function, in SQL; only their lengths leave a text's row."""
    tables.register(spark)
    norm_docs(spark, sf).createOrReplaceTempView("docloom_norm")
    return spark.sql("""
        WITH a AS (SELECT doc_id, sentence_list(norm) AS list FROM docloom_norm),
            s AS (SELECT doc_id, sent_no, n FROM a LATERAL VIEW posexplode(transform(list, x -> char_length(x))) AS sent_no, n)
        SELECT doc_id, sent_no, CAST((sum(n) OVER (w)) - n AS INT) AS char_start, CAST(sum(n) OVER (w) AS INT) AS char_end FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY sent_no)""")


@query(SQL["chunks_fixed_800"])
def chunk_text_sql(spark, sf):
    """The rows of chunks_fixed_800 from the table function, in SQL."""
    tables.register(spark)
    norm_docs(spark, sf).createOrReplaceTempView("docloom_norm")
    return spark.sql("SELECT d.doc_id, c.char_start, c.char_end, md5(CAST(c.content AS BINARY)) AS digest FROM docloom_norm d, LATERAL chunk_text(d.norm) c")


# letters of other languages stand for Vietnamese ones, so that texts have what the old codes write
_PLAIN, _MARKED = "aeioudAEIOUD", "ảếịộừđẢẾỊỘỪĐ"


def _sql_vni(t: str) -> str:
    for letter, code in ((c, legacy.TO_VNI[c]) for c in _MARKED):
        t = f"replace({t}, '{letter}', '{code}')"
    return t


_TCVN = "".join(legacy.TO_TCVN3[c] for c in _MARKED)


@query(f"""WITH v AS (SELECT doc_id, translate(coalesce(text, ''), '{_PLAIN}', '{_MARKED}') AS u FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\\x00-\\x7e]')),
    e AS (SELECT doc_id, u, CASE doc_id % 3 WHEN 0 THEN {"translate(u, '" + _MARKED + "', '" + "".join(c for c in _TCVN) + "')"} WHEN 1 THEN {_sql_vni('u')} ELSE u END AS x FROM v),
    g AS ({quality.SQL_SIGNALS.replace("FROM documents)", "FROM e)").replace(sql_norm(), sql_norm("x"))})
    SELECT doc_id, legacy_encoding, md5(CASE WHEN legacy_encoding IS NULL THEN {sql_norm("x")} ELSE {sql_norm("u")} END) AS digest FROM e JOIN g USING (doc_id)""")
def legacy_transcoded(spark, sf):
    """ASCII documents with Vietnamese letters in TCVN3, VNI and Unicode: what the gate takes for an old code comes back as it was."""
    ascii_only = ~F.coalesce("text", F.lit("")).rlike("[^\\x00-\\x7e]")
    u = F.translate(F.coalesce("text", F.lit("")), _PLAIN, _MARKED)
    vni = F.col("doc_id") % 3 == 1
    code = F.when(F.col("doc_id") % 3 == 0, legacy.to_tcvn3(u)).when(vni, legacy.to_vni(F.when(vni, u))).otherwise(u)
    docs, _, _ = stored(spread(load(spark, sf, "documents").select("doc_id", "text")).filter(ascii_only).select("doc_id", code.alias("text")), "encoded")
    return legacy.transcoded(docs).select("doc_id", "legacy_encoding", F.md5(F.col("norm").cast("binary")).alias("digest"))


_WORDS = "list_filter(list_transform(regexp_split_to_array(lower({t}), '[ \\t\\n\\x{{2028}}\\x{{2029}}]+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> '')"


@query(f"""WITH RECURSIVE {DOCS}, w AS (SELECT {_WORDS.format(t="t")} AS ws FROM d), p AS (SELECT unnest(ws) AS a, unnest(ws[2:] || [NULL]) AS b FROM w),
    c AS (SELECT a, b, count(*) AS c FROM p GROUP BY ALL), s AS (SELECT a, sum(c)::HUGEINT AS n FROM c GROUP BY a), n AS (SELECT sum(n) AS n FROM s),
    lex AS (SELECT * FROM (SELECT c.a, c.b, ((1000::HUGEINT * c.c * n.n) // (x.n * y.n))::BIGINT AS score FROM c JOIN s x ON x.a = c.a JOIN s y ON y.a = c.b, n WHERE c.c >= 5 AND b IS NOT NULL) WHERE score >= 10000),
    q AS (SELECT item_id AS query_id, {_WORDS.format(t=sql_norm())} AS ws FROM benchmark),
    z AS (SELECT query_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i, ws FROM q), o AS (SELECT z.query_id, i, x, coalesce(l.score, 0) AS score, len(ws) AS total FROM z LEFT JOIN lex l ON l.a = ws[i - 1] AND l.b = x AND i > 1),
    walk AS (SELECT query_id, 0 AS i, 0::BIGINT AS one, '' AS path, 0::BIGINT AS two, '' AS before, '' AS last FROM q
        UNION ALL SELECT o.query_id, o.i::INTEGER, CASE WHEN score > 0 AND two + score > one THEN two + score ELSE one END,
            CASE WHEN score > 0 AND two + score > one THEN before || ' ' || last || '_' || x ELSE path || ' ' || x END, one, path, x FROM walk JOIN o ON o.query_id = walk.query_id AND o.i = walk.i + 1)
    SELECT q.query_id, ltrim(path) AS words, CAST(len(regexp_extract_all(path, '_')) AS INTEGER) AS compounds FROM walk JOIN q ON q.query_id = walk.query_id AND walk.i = len(ws)""")
def compound_words(spark, sf):
    """The words of questions, with the pairs that documents write as compounds joined by _."""
    found = compounds.segmented(normalized(load(spark, sf, "benchmark")).withColumnRenamed("item_id", "query_id"), compounds.lexicon(norm_docs(spark, sf)))
    return found.select("query_id", F.array_join("words", " ").alias("words"), F.size(F.filter("words", lambda w: w.contains("_"))).alias("compounds"))


# --- evaluation and totals --------------------------------------------------------------------------------------------

@query()
def cer_whole(spark, sf):
    """Errors in characters of whole texts that an engine reads with letters left out and blanks put in."""
    t = F.coalesce("text", F.lit(""))
    read = F.replace(F.regexp_replace(t, "ing ", "in "), F.lit(". "), F.lit(".  "))
    rows = spread(load(spark, sf, "documents")).select("lang", t.alias("a"), read.alias("b"))
    return evaluation.whole_char_errors(rows, "a", "b", "lang")


@query(f"SELECT * FROM ({SQL['tau_sweep']}) ORDER BY coalesce(f1, 0) DESC, cents LIMIT 1")
def best_tau(spark, sf):
    """The threshold of tau_sweep with the highest F1."""
    return evaluation.best_threshold(QUERIES["tau_sweep"](spark, sf))


@query(f"""WITH {DOCS}, c AS (SELECT source, CASE WHEN t = '' THEN 0 ELSE len(range(0, length(t), 680)) END AS n, length(t) AS chars FROM d)
    SELECT source AS notebook, count(*) AS sources, sum(n)::BIGINT AS chunks, sum(chars)::BIGINT AS chars FROM c GROUP BY source""")
def notebook_totals(spark, sf):
    """Sources, chunks and characters of each notebook; chunks are counted by length, none is made."""
    n = F.ceil(F.char_length("norm") / 680).cast("long")
    return norm_docs(spark, sf, "source").groupBy(F.col("source").alias("notebook")).agg(F.count("*").alias("sources"), F.sum(n).alias("chunks"), F.sum(F.char_length("norm")).alias("chars"))


_REPLY = """m AS (SELECT conv_id, turn, md5(conv_id || ':' || turn) AS id, coalesce(text, '') AS t, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS asker FROM conversations QUALIFY role = 'assistant')"""


@query(f"""WITH {_REPLY}, k AS (SELECT *, length(t) % 5 = 0 AS blocked FROM m),
    e AS (SELECT conv_id, turn, [{_json('meta', message_id='id', mode="'privacy'", model="'local'")}]
        || list_transform(CASE WHEN blocked THEN ['condensing', 'retrieving', 'reranking'] ELSE ['condensing', 'retrieving', 'reranking', 'generating'] END, lambda s: to_json({{'type': 'status', 'stage': s}}))
        || CASE WHEN blocked THEN [{_json('no_answer', top_score='0.25::DOUBLE', threshold='0.35::DOUBLE')}]
           ELSE [{_json('citation', marker='1', chunk_id='turn', source_title="'s' || conv_id", snippet='left(t, 40)')}] END
        || [{_json('done', message_id='id', answer_kind="CASE WHEN blocked THEN 'no_answer' ELSE 'grounded' END", latency_ms='length(t)', model_used="'local'")}] AS ev FROM k)
    SELECT conv_id, turn, CAST(generate_subscripts(ev, 1) - 1 AS INTEGER) AS no, md5(unnest(ev)::VARCHAR) AS digest FROM e""")
def reply_events(spark, sf):
    """What a listener hears of each answer: start, steps, citations or the gate's refusal, end."""
    c = load(spark, sf, "conversations").filter("role = 'assistant'").withColumn("text", F.coalesce("text", F.lit("")))
    blocked = F.char_length("text") % 5 == 0
    cited = F.struct(F.lit(1).alias("marker"), F.col("turn").alias("chunk_id"), F.concat(F.lit("s"), F.col("conv_id")).alias("source_title"), F.substring("text", 1, 40).alias("snippet"))
    rows = c.select("conv_id", "turn", F.md5(F.concat(F.col("conv_id"), F.lit(":"), F.col("turn")).cast("binary")).alias("message_id"), F.lit("privacy").alias("mode"), F.lit("local").alias("model"), F.when(blocked, "no_answer").otherwise("grounded").alias("answer_kind"), F.when(blocked, 0.25).otherwise(0.9).alias("top_score"), F.lit(0.35).alias("threshold"), F.char_length("text").alias("latency_ms"), F.array(cited).alias("citations"))
    return answers.reply_events(rows, "conv_id", "turn").select("conv_id", "turn", "no", F.md5(F.col("event").cast("binary")).alias("digest"))


# --- sources ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {DOCS}, k AS (SELECT doc_id, t, ['txt', 'md', 'paste', 'json', 'exe'][doc_id % 5 + 1] AS kind FROM d)
    SELECT doc_id, kind, CASE kind WHEN 'exe' THEN NULL WHEN 'json' THEN 'blocks' ELSE 'plain:utf-8-sig' END AS method, md5(CASE WHEN kind = 'exe' THEN '' ELSE t END) AS digest,
        CASE WHEN kind = 'exe' THEN 'KIND_UNSUPPORTED' WHEN trim(regexp_replace(t, '\\s+', ' ', 'g')) = '' THEN 'TEXT_EMPTY' END AS error_code FROM k""")
def source_kinds(spark, sf):
    """Documents as files of five kinds, read through the registry; the JSON ones are lists of their lines."""
    kind = F.get(F.array(*map(F.lit, ["txt", "md", "paste", "JSON", "exe"])), (F.col("doc_id") % 5).cast("int"))
    t = F.coalesce("text", F.lit(""))
    lines = F.to_json(F.transform(F.split(t, "\n"), lambda x: F.struct(F.lit(1).alias("page"), x.alias("text"))))
    files = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), kind.alias("kind"), F.encode(F.when(kind == "JSON", lines).otherwise(t), "UTF-8").alias("content"))
    return registry.documents(files).select(F.col("path").cast("long").alias("doc_id"), "kind", "method", F.md5(F.col("norm").cast("binary")).alias("digest"), "error_code")


_STYLES = ["Heading 2", "Normal", "Title", "List Bullet", "Tiêu đề chính", "đầu đề 12", "heading", "Subtitle", "Danh sách 2", "Tiêu đề 3"]
_PREFIX = ["## ", "", "# ", "- ", "# ", "###### ", "# ", "", "- ", "### "]


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM d)
    SELECT doc_id, CAST(i AS INTEGER) AS no, md5({_PREFIX}[i % 10 + 1] || x) AS digest FROM l""")
def styled_lines(spark, sf):
    """Lines as paragraphs of ten styles, in Markdown."""
    lines = norm_docs(spark, sf).select("doc_id", F.posexplode(F.split("norm", "\n")).alias("no", "x"))
    style = F.get(F.array(*map(F.lit, _STYLES)), (F.col("no") % 10).cast("int"))
    return lines.select("doc_id", "no", F.md5(extract.styled(style, F.col("x")).cast("binary")).alias("digest"))


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM d),
    r AS (SELECT doc_id, i // 4 AS table_no, i, list_transform(string_split(x, ' ')[1:3], lambda c: trim(c)) AS cells FROM l),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY i) AS k FROM r WHERE len(list_filter(cells, lambda c: c <> '')) > 0)
    SELECT doc_id, CAST(table_no AS INTEGER) AS table_no, md5(string_agg('| ' || array_to_string(cells, ' | ') || ' |' || CASE WHEN k = 1 THEN chr(10) || '|' || repeat(' --- |', len(cells)) ELSE '' END, chr(10) ORDER BY i)) AS digest FROM n GROUP BY doc_id, table_no""")
def markdown_tables(spark, sf):
    """Four lines are a table, the first words of each its cells."""
    lines = norm_docs(spark, sf).select("doc_id", F.posexplode(F.split("norm", "\n")).alias("row_no", "x"))
    rows = lines.select("doc_id", F.floor(F.col("row_no") / 4).cast("int").alias("table_no"), "row_no", F.slice(F.split("x", " "), 1, 3).alias("cells"))
    return extract.table_markdown(rows).select("doc_id", "table_no", F.md5(F.col("text").cast("binary")).alias("digest"))
