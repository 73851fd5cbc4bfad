"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcat.functions.dates import display_time, parse_call_time, parse_iso
from semcat.functions.html import clean_strings, with_html_text
from semcat.functions.ids import id_hash, id_source, topic_url
from semcat.functions.jsonx import json_first, json_scalars
from semcat.functions.text import (
    FULL_SECTION,
    SHORT_SECTION,
    api_list,
    compact_list,
    keyword_list,
    normalise_list,
    normalise_string,
    or_missing,
    percent,
    safe_join,
    section,
)
from semcat.operators import chunk, clean, diff, embed, facets, normalise, render, results, topk
from semcat.plans import ingest, search
from semcat.plans.sync import sync
from semcat.registry.fixtures import (
    DIM,
    CharacterCodec,
    doc_uuid,
    event_pages,
    land_archives,
    land_pages,
    land_programmes,
    programmes,
    stored_ids,
    stored_points,
    table,
    text_queries,
    vector_queries,
    zipped_documents,
)
from semcat.schema import ORDER_COLUMN, PROGRAMME_SCHEMA, conform
from semcat.session import spread, work_dir, written
from semcat.sources import catalogue, pages, snapshots
from semcat.sources.store import VectorStore
from semcat.streaming.refresh import calls_stream, refresh_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

c, lit = F.col, F.lit
K = 10
FILTERS = results.FacetFilter(locations=("en", "fr", "de"), funding_area=("en", "src1", "src2", "de"), drop_na=True)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def piped(column: str, name: str | None = None):
    return F.array_join(c(column), "|").alias(name or column)


def stamp(column) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# -- scalar functions ------------------------------------------------------


@query
def q_uuid5(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", doc_uuid(c("doc_id")).alias("uuid"), doc_uuid(c("text")).alias("text_uuid")
    )


@query
def q_idhash_fallback(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    source = id_source(
        F.when(c("toxic") == 1, F.concat(lit(" CALL "), c("source"))),
        F.when(c("quality") == 1, F.concat(lit("ID-"), c("doc_id").cast("string"))).when(c("quality") == 0, lit("  ")),
        F.when(c("lang") == "en", F.concat(lit("doc/"), c("doc_id").cast("string"))),
        F.concat(lit("title "), c("doc_id").cast("string")),
    )
    return docs.join(labels, "doc_id", "left").select("doc_id", source.alias("source_id"), id_hash(source).alias("id_hash"))


@query
def q_html_text(spark, sf):
    return with_html_text(table(spark, sf, "pages"), {"text": "html"}).select("page_id", "text")


@query
def q_html_text_parser(spark, sf):
    """A processing instruction in front sends every page to the parser."""
    odd = table(spark, sf, "pages").withColumn("html", F.concat(lit("<?page ?>"), c("html")))
    return with_html_text(odd, {"text": "html"}).select("page_id", "text")


@query
def q_sections(spark, sf):
    wrapped = F.concat(
        lit("<h3>Kurztext</h3>"), c("source"), lit(" "), c("lang"), lit("<h3> Volltext </h3>"), c("text")
    )
    return table(spark, sf, "documents").select(
        "doc_id",
        section(wrapped, SHORT_SECTION).alias("short"),
        section(wrapped, FULL_SECTION).alias("full_text"),
    )


@query
def q_null_default(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", or_missing(F.when(c("lang") == "fr", lit("")).when(c("lang") != "es", c("lang"))).alias("lang")
    )


@query
def q_english(spark, sf):
    language = F.when(c("lang") != "es", F.upper("lang"))
    others = F.array(F.when(c("lang") == "de", lit("En-gb")), c("source"))
    return table(spark, sf, "documents").select("doc_id", normalise.is_english(language, others).alias("english"))


@query
def q_combine_desc(spark, sf):
    short = F.when(c("lang") == "fr", lit("N/A")).when(c("lang") == "de", c("source")).otherwise(c("text"))
    summary = normalise.summary_or_description(short, c("text"))
    return table(spark, sf, "documents").select(
        "doc_id", summary.alias("summary"), normalise.combined_description(summary, c("text")).alias("description")
    )


@query
def q_keywords(spark, sf):
    raw = F.array(
        F.concat(lit(" "), c("lang"), lit("\t")), c("source"), lit(None), lit(" "), c("lang"),
        F.concat(lit("ID-"), c("doc_id").cast("string")), c("source"), lit("b"),
    )
    blocked = F.concat(lit("ID-"), c("doc_id").cast("string"))
    kept = keyword_list(normalise_list(raw), blocked, F.when(c("lang") == "de", c("source")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(kept, "|").alias("keywords"))


@query
def q_parse_ts(spark, sf):
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(c("event_type") == "view", F.concat(base, F.date_format("ts", ".SSSSSS"), lit("+0200")))
        .when(c("event_type") == "click", F.concat(base, lit(".5Z")))
        .when(c("event_type") == "error", F.concat(base, lit("Z")))
        .when(c("event_type") == "purchase", F.concat(lit(" "), base, lit(".250-05:30\n")))
        .otherwise(F.concat(lit("2024-13-01T00:00:"), F.date_format("ts", "ss"), lit(".0Z")))
    )
    return table(spark, sf, "events").select(
        "event_id", stamp(parse_call_time(raw)).alias("call_time"), stamp(parse_iso(raw)).alias("iso_time")
    )


@query
def q_json_first(spark, sf):
    k = F.get_json_object("props", "$.k")
    nested = F.concat(lit('[null,"",{"label":'), k, lit(',"id":" "}]'))
    listed = F.concat(lit('["a",null,{"code":['), k, lit("]},'' ,\"a\"]"))
    listed = F.replace(listed, lit("''"), lit('""'))
    return spread(table(spark, sf, "events")).select(
        "event_id",
        json_first(k).alias("k"),
        json_first(nested).alias("nested"),
        F.array_join(json_scalars(listed), "|").alias("listed"),
    )


@query
def q_topic_url(spark, sf):
    name = F.when(c("n_regionkey") == 0, lit("")).when(c("n_regionkey") != 1, c("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", topic_url(name, normalise.TOPIC_URL).alias("url"))


@query
def q_list_display(spark, sf):
    """The three list forms of the result page, plus date and score strings."""
    tags = F.when(c("o_orderstatus") == "P", F.array(lit(None).cast("string"))).when(
        c("o_orderstatus") == "F", F.array(c("o_orderpriority"), lit(None), c("o_orderstatus"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        safe_join(tags).alias("joined"),
        F.size(api_list(tags)).cast("long").alias("n_api"),
        F.size(compact_list(tags)).cast("long").alias("n_compact"),
        display_time(c("o_orderdate")).alias("shown_date"),
        percent(c("o_totalprice").cast("int") / 1000000).alias("shown_score"),
    )


# -- normalisation and cleaning --------------------------------------------


@query
def q_rename_conform(spark, sf):
    dump = table(spark, sf, "orders").select(
        c("o_orderkey").cast("string").alias("id_hash"),
        c("o_orderdate").alias("on_website_from"),
        F.when(c("o_orderstatus") == "F", c("o_orderdate")).alias("last_updated"),
        c("o_orderpriority").alias("title"),
        (c("o_orderstatus") == "F").alias("deleted"),
    )
    shaped = conform(normalise.dump_to_programmes(dump), PROGRAMME_SCHEMA)
    return shaped.select(
        "id_hash", "title", stamp(c("date_1")).alias("date_1"), stamp(c("date_2")).alias("date_2"), "deleted",
        "id_url", F.coalesce(F.size("funding_area").cast("long"), lit(-1)).alias("n_areas"),
        lit(len(shaped.columns)).cast("long").alias("n_columns"),
    )


@query
def q_status_filter(spark, sf):
    status = F.create_map(*[lit(x) for x in ("F", "31094503", "O", "31094502")])[c("o_orderstatus")]
    rows = table(spark, sf, "orders").select("o_orderkey", status.alias("status"))
    return rows.filter(normalise.allowed_status(c("status"))).select(
        "o_orderkey", "status", normalise.is_withdrawn(c("status")).alias("deleted")
    )


def _calls(spark, sf):
    """Documents as normalised calls; the first ones carry a page's HTML."""
    docs = table(spark, sf, "documents").alias("d")
    labels = table(spark, sf, "labels")
    html = table(spark, sf, "pages").select(c("page_id").alias("doc_id"), "html")
    times = table(spark, sf, "events").select(c("event_id").alias("doc_id"), "ts")
    text_id = c("doc_id").cast("string")
    return (
        docs.join(labels, "doc_id", "left").join(html, "doc_id", "left").join(times, "doc_id", "left")
        .select(
            F.concat(lit(" ID-"), text_id).alias("id"),
            F.when(c("lang") != "es", F.concat(lit("Title "), text_id)).alias("title"),
            F.when(c("quality") == 0, F.concat(lit("CALL-"), c("source"))).alias("call_id"),
            c("source").alias("programme"),
            F.when(c("toxic") == 1, lit("31094503")).when(c("lang") == "fr", lit("31094509"))
            .when(c("quality") == 1, lit("31094501")).otherwise(lit("31094502")).alias("status_code"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0200'").alias("start_date"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("deadline"),
            F.concat(lit("https://example.org/"), text_id).alias("url"),
            F.when(c("lang") == "de", F.concat(lit("<b>"), c("source"), lit("</b> &amp;amp; x"))).when(
                c("lang") == "en", c("text")
            ).alias("summary"),
            F.coalesce("html", "text").alias("description_html"),
            F.array(c("source"), c("lang"), c("source"), F.concat(lit("ID-"), text_id)).alias("keywords"),
            c("lang").alias("language"),
            F.array("lang").alias("metadata_languages"),
            c("doc_id").alias(ORDER_COLUMN),
        )
    )


@query
def q_normalise_calls(spark, sf):
    return normalise.calls_to_programmes(_calls(spark, sf)).select(
        ORDER_COLUMN, "id_hash", "id_url", "url", "title", "description", "more_info",
        piped("funding_type"), piped("funding_area"), piped("funding_location"),
        F.size("eligible_applicants").cast("long").alias("n_eligible"), "funding_body",
        stamp(c("date_1")).alias("date_1"), stamp(c("date_2")).alias("date_2"), "deleted",
        "project_short_description", "project_full_description", "uuid_source_call_id",
    )


@query
def q_clean_programmes(spark, sf):
    """Sections, defaults and HTML cleaning over every string column, then ids."""
    p = table(spark, sf, "pages")
    raw = p.select(
        "page_id",
        F.when(c("page_id") > 0, F.concat(lit(" "), c("url"))).alias("url"),
        F.concat(lit("<h3>Kurztext</h3><p>"), c("url"), lit("</p>\t<h3>Volltext</h3>"), c("html")).alias("description"),
        lit("").alias("more_info"),
    )
    return clean.with_uuid(clean.clean_programmes(raw), "url").select(
        "page_id", "url", "description", "more_info", "project_short_description", "project_full_description", "uuid"
    )


@query
def q_clean_strings(spark, sf):
    mixed = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(lit("\n"), c("text"), lit(" ")).alias("text"),
        F.when(c("lang") != "fr", F.concat(lit("<i>"), c("lang"), lit("</i>&nbsp;&lt;b&gt;"))).alias("lang"),
    )
    return clean_strings(mixed)


# -- API pages --------------------------------------------------------------


@query
def q_page_cut(spark, sf):
    cut = pages.before_first_empty(pages.parsed_pages(event_pages(spark, sf, only="error")), max_pages=None)
    items = pages.page_items(cut)
    return items.select("page", json_first(F.get_json_object("item", "$.metadata.identifier")).alias("id"))


@query
def q_requested_items(spark, sf):
    items = pages.requested_items(pages.page_items(pages.parsed_pages(event_pages(spark, sf))))
    return items.groupBy("page").agg(F.count(lit(1)).alias("n_items"))


@query
def q_calls(spark, sf):
    items = pages.page_items(pages.parsed_pages(event_pages(spark, sf)))
    return normalise.kept_calls(normalise.items_to_calls(items)).select(
        "page", "id", "call_id", "status_code", "start_date", "url", "summary", "description_html",
        piped("keywords"), "language", piped("metadata_languages"),
    )


@query
def q_page_stats(spark, sf):
    items = pages.page_items(pages.parsed_pages(event_pages(spark, sf)))
    return normalise.page_counters(normalise.items_to_calls(items))


@query
def q_json_snapshot(spark, sf):
    """Calls written as a JSON snapshot, then read back after a failed refresh."""
    root = work_dir(spark, "snapshots")
    snapshots.fresh_or_cached_calls(spark, lambda: _calls(spark, sf), root, "b1")

    def unreachable():
        raise ConnectionError("source not reachable")

    calls = snapshots.fresh_or_cached_calls(spark, unreachable, root, "b2")
    return calls.select("id", "title", "call_id", "status_code", "description_html", "summary", piped("keywords"))


def _stored_calls(spark, root):
    return catalogue.read_programmes(spark, f"{root}/out/uuid").select(
        "uuid", "id_hash", "id_url", "title", "description", "more_info", piped("funding_area"), "deleted",
        "project_short_description", stamp(c("date_1")).alias("date_1"), "checksum",
    )


@query
def q_ingest_pages(spark, sf):
    """Landed pages of a broader request to the stored table with ids."""
    root = work_dir(spark, "ingest")
    landed = land_pages(spark, sf, root)
    ingest.ingest_pages(spark, landed, f"{root}/cache", "b1", f"{root}/out", per_line=True, asked_only=False)
    return _stored_calls(spark, root)


@query
def q_ingest_asked_pages(spark, sf):
    """The request's own conditions; the next day's pages are missing and the cached calls stand in."""
    root = work_dir(spark, "ingest")
    landed = land_pages(spark, sf, root)
    ingest.ingest_pages(spark, landed, f"{root}/cache", "b1", f"{root}/first", per_line=True)
    ingest.ingest_pages(spark, f"{root}/nothing-landed", f"{root}/cache", "b2", f"{root}/out", per_line=True)
    return _stored_calls(spark, root)


@query
def q_stream_calls(spark, sf):
    """The same pages normalised as a file stream."""
    root = work_dir(spark, "stream-calls")
    landed = land_pages(spark, sf, root)
    calls_stream(spark, landed, f"{root}/calls", f"{root}/checkpoint", per_line=True, asked_only=False).awaitTermination()
    return spark.read.parquet(f"{root}/calls").groupBy("status_code").agg(
        F.count(lit(1)).alias("n_calls"), F.countDistinct("id").alias("n_ids")
    )


# -- dump archives and facets ----------------------------------------------


@query
def q_zip_scan(spark, sf):
    archives = zipped_documents(spark, sf)
    schema = table(spark, sf, "documents").select("doc_id", "lang", "source", "text").schema
    return catalogue.archive_rows(archives, schema).drop(ORDER_COLUMN)


@query
def q_read_archives(spark, sf):
    """Landed archives, unpacked into the shared folder and read by row group; two of the columns."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    landed = land_archives(spark, docs, work_dir(spark, "archives"))
    rows = catalogue.read_archives(spark, landed, docs.select("doc_id", "text").schema)
    return rows.select("doc_id", "text")


@query
def q_ingest_dump(spark, sf):
    """Documents as landed archives, cleaned, given ids and stored."""
    root = work_dir(spark, "dump")
    dump = programmes(spark, sf, dated=True).drop("uuid", "project_short_description", "project_full_description", ORDER_COLUMN)
    dump = dump.withColumnsRenamed({"date_1": "on_website_from", "date_2": "last_updated"}).withColumn(
        "id_hash", F.md5(c("url"))
    )
    ingest.ingest_dump(spark, land_archives(spark, dump, root), dump.schema, f"{root}/out")
    return catalogue.read_programmes(spark, f"{root}/out/uuid").select(
        "uuid", "id_hash", "title", "description", "project_short_description", stamp(c("date_1")).alias("date_1"),
        F.coalesce(c("deleted").cast("string"), lit("unknown")).alias("deleted"),
    )


def _variants(spark, sf):
    """Spellings of part names in list and plain columns."""
    name = c("p_name")
    return table(spark, sf, "part").select(
        c("p_partkey").alias(ORDER_COLUMN),
        F.array(F.replace(name, lit(" "), lit("_")), F.initcap(name), F.upper(name), F.replace(name, lit(" "), lit("-")), lit(None)).alias("names"),
        F.when(c("p_size") > 25, F.concat(lit(" "), c("p_type"))).otherwise(F.lower("p_type")).alias("kind"),
        F.when(c("p_size") > 3, c("p_brand")).when(c("p_size") > 2, lit(" NaN ")).alias("brand"),
        F.array(F.when(c("p_size") < 10, lit("ab")), F.when(c("p_size") > 40, lit("N/A"))).alias("odd"),
    )


@query
def q_facets(spark, sf):
    parts = table(spark, sf, "part").select(c("p_partkey").alias(ORDER_COLUMN), "p_name")
    return facets.facet_values(parts, ("p_name",))


@query
def q_facets_multi(spark, sf):
    return facets.facet_values(_variants(spark, sf), ("names", "kind", "brand", "odd"))


@query
def q_facet_options(spark, sf):
    """Facet lists written as text and read back."""
    root = work_dir(spark, "facets")
    catalogue.write_facets(facets.facet_values(_variants(spark, sf), ("names",)), root, ("names",), "x_")
    return catalogue.read_facet_options(spark, f"{root}/x_names.txt")


# -- chunks and vectors -----------------------------------------------------


@query
def q_chunks(spark, sf):
    return chunk.chunks(table(spark, sf, "documents"), "text", keep=("doc_id",)).select(
        "doc_id", c("chunk_no").cast("long").alias("chunk_no"), "chunk_text"
    )


@query
def q_chunks_codec(spark, sf):
    """Windows over the tokens of a codec that runs in Python."""
    tokenizer = chunk.CodecTokenizer(CharacterCodec)
    cut = chunk.chunks(table(spark, sf, "documents"), "text", tokenizer, 1000, 100, keep=("doc_id",))
    return cut.select("doc_id", c("chunk_no").cast("long").alias("chunk_no"), "chunk_text")


@query
def q_chunk_counts(spark, sf):
    n = chunk.window_count(chunk.WordTokenizer().encode(c("text")), 50, 20)
    return spread(table(spark, sf, "documents")).select("doc_id", n.cast("long").alias("n_chunks"))


@query
def q_embed_hash(spark, sf):
    """Every chunk's vector, checked by the positions and signs of its values."""
    cut = chunk.chunks(table(spark, sf, "documents"), "text", keep=("doc_id",))
    vectors = embed.with_vectors(cut, embed.hashing_embedder())
    signed = F.transform("vector", lambda x, i: F.signum(x).cast("long") * (i + 1))
    return vectors.select(
        "doc_id",
        c("chunk_no").cast("long").alias("chunk_no"),
        F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("n_values"),
        F.aggregate(signed, lit(0).cast("long"), lambda a, x: a + x).alias("signature"),
    )


# -- refresh ----------------------------------------------------------------


@query
def q_withdrawn(spark, sf):
    return diff.ids_to_delete(stored_ids(spark, sf), programmes(spark, sf))


@query
def q_remaining(spark, sf):
    return diff.remaining_ids(stored_ids(spark, sf), programmes(spark, sf))


@query
def q_new_rows(spark, sf):
    rows = programmes(spark, sf)
    ids = written(diff.new_ids(rows, diff.remaining_ids(stored_ids(spark, sf), rows)), "fresh")
    return diff.new_active_rows(rows, ids).select("uuid", "description")


def _store(spark, sf):
    store = VectorStore.open(spark, work_dir(spark, "store"), "given", DIM)
    points = stored_points(spark, sf)
    store.upsert(points, points.select("uuid"))
    return store


@query
def q_ids_scan(spark, sf):
    return _store(spark, sf).ids()


@query
def q_upsert(spark, sf):
    """Points of withdrawn and new documents replaced by a second chunk."""
    store = _store(spark, sf)
    docs = programmes(spark, sf).filter(c("deleted").isNotNull()).select("uuid")
    vector = F.transform(F.sequence(lit(1), lit(DIM)), lambda i: i.cast("float"))
    store.upsert(docs.select("uuid", lit(7).alias("chunk_no"), vector.alias("vector")), docs)
    return store.points().select(
        "uuid", c("chunk_no").cast("long").alias("chunk_no"),
        F.round(F.element_at("vector", 1).cast("double"), 5).alias("first_value"),
    )


@query
def q_delete(spark, sf):
    store = _store(spark, sf)
    store.delete(diff.ids_to_delete(store.ids(), programmes(spark, sf)))
    store.compact()
    return store.points().select("uuid", c("chunk_no").cast("long").alias("chunk_no"))


@query
def q_sync(spark, sf):
    """Deletion, chunking, embedding and insertion against the stored vectors."""
    embedder = embed.hashing_embedder(DIM)
    store = VectorStore.open(spark, work_dir(spark, "store"), embedder.name, DIM)
    points = stored_points(spark, sf)
    store.upsert(points, points.select("uuid"))
    sync(programmes(spark, sf), store, embedder)
    return store.points().groupBy("uuid").agg(F.count(lit(1)).alias("n_points"))


@query
def q_sync_stats(spark, sf):
    """The counts a refresh reports; every document comes twice."""
    embedder = embed.hashing_embedder(DIM)
    store = VectorStore.open(spark, work_dir(spark, "store"), embedder.name, DIM)
    points = stored_points(spark, sf)
    store.upsert(points, points.select("uuid"))
    rows = programmes(spark, sf)
    again = rows.withColumn(ORDER_COLUMN, -c(ORDER_COLUMN) - 1)
    return spark.createDataFrame([asdict(sync(rows.unionByName(again), store, embedder))])


def _refreshed_store(spark, sf):
    root = work_dir(spark, "stream")
    rows = programmes(spark, sf)
    share = land_programmes(rows, f"{root}/landed")
    embedder = embed.hashing_embedder(DIM)
    store = VectorStore.open(spark, f"{root}/store", embedder.name, DIM)
    stream = refresh_stream(
        spark, f"{root}/landed", rows.schema, store, embedder, f"{root}/checkpoint", files_per_batch=share, keep="last"
    )
    stream.awaitTermination()
    return store


@query
def q_stream_refresh(spark, sf):
    """Programme files arriving as a stream; the store must end up with all new rows."""
    return _refreshed_store(spark, sf).payload().select("uuid", "description")


@query
def q_stream_points(spark, sf):
    """The points that such a stream leaves: the last chunk of every programme."""
    return _refreshed_store(spark, sf).points().select("uuid", c("chunk_no").cast("long").alias("chunk_no"))


# -- search -----------------------------------------------------------------


@query
def q_topk_single(spark, sf):
    hits = topk.top_k_single(stored_points(spark, sf), [float(i % 5 - 2) for i in range(DIM)], 50)
    return hits.select("uuid", F.round("score", 5).alias("score"))


def _hits(spark, sf):
    return topk.top_k(stored_points(spark, sf), vector_queries(spark, sf), K)


@query
def q_topk_batch(spark, sf):
    return _hits(spark, sf).select(
        "qid", c("rank").cast("long").alias("rank"), "uuid", F.round("score", 5).alias("score")
    )


@query
def q_topk_blocked(spark, sf):
    """The same search by the way that serves query tables too large to broadcast."""
    hits = topk.top_k(stored_points(spark, sf), vector_queries(spark, sf), K, broadcast_bytes=64_000)
    return hits.select("qid", c("rank").cast("long").alias("rank"), "uuid", F.round("score", 5).alias("score"))


def _label_payload(spark, sf):
    """Vectors of one label as chunks of one project; label 0 has no project id."""
    title = F.concat(lit("vec "), c("vec_id").cast("string"))
    area = F.concat(lit("area "), c("label").cast("string"))
    return table(spark, sf, "embeddings").select(
        doc_uuid(c("vec_id")).alias("uuid"),
        F.when(c("label") == 0, lit("")).otherwise(F.concat(lit("label/"), c("label").cast("string"))).alias("id_url"),
        title.alias("title"), title.alias("project_short_description"), title.alias("project_full_description"),
        lit(None).cast("timestamp_ntz").alias("date_1"), lit(None).cast("timestamp_ntz").alias("date_2"), title.alias("url"),
        F.array(area).alias("funding_type"), lit(None).cast("array<string>").alias("funding_area"),
        F.array(area, lit(None)).alias("funding_location"), F.array().cast("array<string>").alias("eligible_applicants"),
    )


def _shown(df):
    return df.select(
        "qid", c("rank").cast("long").alias("rank"), "project_id", "project_title",
        F.size("funding_area").cast("long").alias("n_areas"), F.round("matching_score", 5).alias("matching_score"),
    )


def _collapsed(spark, sf):
    hits, bound = topk.bounded_top_k(stored_points(spark, sf), vector_queries(spark, sf), K)
    return results.collapse_hits(hits, _label_payload(spark, sf), bound)


@query
def q_collapse_hits(spark, sf):
    return _shown(_collapsed(spark, sf))


@query
def q_collapse_again(spark, sf):
    """Results with other ids: projects merge further, blank ids are dropped."""
    merged = F.when(c("project_id").isin("label/1", "label/2"), lit("label/1")).when(
        c("project_id") != "label/3", c("project_id")
    )
    return _shown(results.collapse_again(_collapsed(spark, sf).withColumn("project_id", merged)))


def _search(spark, sf, filters=None, dated=False):
    rows = programmes(spark, sf, dated)
    return search.search_vectors(vector_queries(spark, sf), stored_points(spark, sf), rows, K, filters)


@query
def q_search_filtered(spark, sf):
    return _search(spark, sf, FILTERS).select(
        "qid", c("rank").cast("long").alias("rank"), "project_id", "project_title", piped("funding_area"),
        F.round("matching_score", 5).alias("matching_score"),
    )


@query
def q_search_by_key(spark, sf):
    """Filters that match every spelling behind a facet value."""
    filters = results.FacetFilter(locations=(" EN ", "Fr"), drop_na=False)
    rows = programmes(spark, sf).withColumn("funding_location", F.array(F.initcap(c("funding_location")[0])))
    found = search.search_vectors(
        vector_queries(spark, sf), stored_points(spark, sf),
        rows, K, filters, match="key",
    )
    return found.select("qid", c("rank").cast("long").alias("rank"), "project_id", piped("funding_location"))


@query
def q_render(spark, sf):
    return render.dump_cards(_search(spark, sf, dated=True)).withColumn("rank", c("rank").cast("long"))


@query
def q_render_calls(spark, sf):
    return render.call_cards(_search(spark, sf, dated=True)).withColumn("rank", c("rank").cast("long"))


@query
def q_query_validation(spark, sf):
    whole = table(spark, sf, "documents").select(F.concat(lit("d"), c("doc_id")).alias("qid"), "text")
    emptied = text_queries(spark, sf).select("qid", "text").unionByName(whole).withColumn("text", F.when(F.length("text") > 60, c("text")).otherwise(lit("")))
    return search.valid_queries(emptied)


@query
def q_normalise_string(spark, sf):
    padded = F.concat(lit("  \t"), F.when(c("role") == "user", c("text")).otherwise(lit("")), lit(" \x1f\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", normalise_string(padded).alias("text"))


@query
def q_search_text(spark, sf):
    """The whole way: documents chunked, embedded, searched by user messages, filtered."""
    rows = programmes(spark, sf).filter(~c("deleted"))
    embedder = embed.hashing_embedder()
    points = embed.with_vectors(chunk.chunks(rows), embedder)
    queries = search.embed_queries(search.valid_queries(text_queries(spark, sf)), embedder)
    return search.search_vectors(queries, points, rows, topk.DEFAULT_LIMIT, FILTERS).select(
        "qid", c("rank").cast("long").alias("rank"), "project_id", "project_title", piped("funding_area"),
        F.round("matching_score", 5).alias("matching_score"),
    )


def _search_store(spark, sf):
    """All documents synced into a new store, then searched there by user messages."""
    embedder = embed.hashing_embedder()
    store = VectorStore.open(spark, work_dir(spark, "store"), embedder.name, embedder.dim)
    sync(programmes(spark, sf), store, embedder)
    return search.search(text_queries(spark, sf), store, embedder, search.check_limit(topk.DEFAULT_LIMIT), FILTERS)


@query
def q_search_store(spark, sf):
    return _search_store(spark, sf).select(
        "qid", c("rank").cast("long").alias("rank"), "project_id", "project_title", piped("funding_area"),
        F.round("matching_score", 5).alias("matching_score"),
    )


@query
def q_result_counts(spark, sf):
    """Results of every query of such a search."""
    asked = search.valid_queries(text_queries(spark, sf))
    return search.result_counts(asked, _search_store(spark, sf))
