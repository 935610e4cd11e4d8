"""Named queries: (spark, sf_dir) -> DataFrame, one per inventory operator.

Each reads the driver tables (or data Spark derives from them) through the
fixture derivations, then applies the library operators. Computed columns are
aliased to the names the oracle SQL uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelens import fixtures as fx
from framelens.operators import rollups, sketches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@query("tactics_summary")
def q_tactics_summary(spark, sf_dir):
    return rollups.tactics_summary(fx.articles(spark, sf_dir))


@query("source_breakdown")
def q_source_breakdown(spark, sf_dir):
    return rollups.source_breakdown(fx.articles(spark, sf_dir))


@query("distinct_days")
def q_distinct_days(spark, sf_dir):
    """Distinct users per event type from stored sketches of the days, held against the exact count."""
    events = fx.table(spark, sf_dir, "events")
    path = staging_path(spark, "day-sketches")
    sketches.day_sketches(events, F.to_date("ts"), ["event_type"], "user_id").write.partitionBy("day").parquet(path)
    estimates = sketches.distinct_over(spark.read.parquet(path), ["event_type"])
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"))
    near = F.abs(F.col("estimate") - F.col("n_users")) <= sketches.stated_error() * F.col("n_users")
    return (exact.withColumnRenamed("event_type", "type").join(estimates, F.col("type").eqNullSafe(F.col("event_type")))
            .select("event_type", "rows", "n_users", near.alias("within_error")))


# --- ingest -----------------------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from framelens.operators import ingest  # noqa: E402
from framelens.operators.indexing import dense_index  # noqa: E402
from framelens.schema import RAW_ARTICLE_COLUMNS  # noqa: E402
from framelens.session import checkpoint_dir, staging_path, stored  # noqa: E402
from framelens.sources.landed import read_landed_csv  # noqa: E402


def _raw_union(spark, sf_dir):
    root = fx.land_raw_files(spark, sf_dir)
    # the files are parsed once; the index and the dedupe read the stored union several times
    path = staging_path(spark, "union")
    read_landed_csv(spark, root).write.parquet(path)
    u = spark.read.parquet(path)
    return dense_index(u, "_order", "pos").select("pos", *RAW_ARTICLE_COLUMNS)


def _indexed_union(spark, sf_dir):
    path = staging_path(spark, "indexed-union")
    _raw_union(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@query("raw_union")
def q_raw_union(spark, sf_dir):
    return _raw_union(spark, sf_dir)


@query("dedupe_first")
def q_dedupe_first(spark, sf_dir):
    return ingest.dedupe_first(_indexed_union(spark, sf_dir), ["title", "source"], "pos")


@query("clean_articles")
def q_clean_articles(spark, sf_dir):
    c = ingest.clean_articles(_indexed_union(spark, sf_dir), "pos")
    return c.select("row_idx", *RAW_ARTICLE_COLUMNS)


@query("row_index")
def q_row_index(spark, sf_dir):
    a = ingest.full_text_fallback(ingest.drop_conflicted(fx.articles(spark, sf_dir)))
    return dense_index(a.withColumnRenamed("row_idx", "src_idx"), "src_idx", "row_idx")


def _classified(spark, sf_dir):
    return ingest.load_classified(fx.articles(spark, sf_dir)).withColumnRenamed("_src_idx", "src_idx")


@query("load_classified")
def q_load_classified(spark, sf_dir):
    return _classified(spark, sf_dir)


from framelens.sources.snapshots import Snapshots  # noqa: E402


@query("classified_mapped")
def q_classified_mapped(spark, sf_dir):
    """The classified table is stored, then rewritten with coordinates (here the first three components of the
    given vectors) from its own last version, and served from the new one: no coordinate or NaN reads 0."""
    tables = Snapshots(spark, staging_path(spark, "classified"))
    tables.publish({"classified": _classified(spark, sf_dir)})
    axes = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")]
    coords = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src_idx"), *axes)
    tables.publish({"classified": tables.read("classified").join(coords, "src_idx", "left")})
    served = [F.round(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), 6).alias(c) for c in "xyz"]
    return tables.read("classified").select("row_idx", "source", "title", "tactic_label", *served)


@query("headlines_page")
def q_headlines_page(spark, sf_dir):
    return ingest.headlines_page(_classified(spark, sf_dir), 100)


def _top_entries(spark, sf_dir):
    return ingest.feed_topk(fx.feed_entries(spark, sf_dir))


@query("feed_topk")
def q_feed_topk(spark, sf_dir):
    return _top_entries(spark, sf_dir).select("source", "pos", "title")


@query("feed_enrich")
def q_feed_enrich(spark, sf_dir):
    return _enriched(spark, sf_dir).select("source", "pos", "perspective", "original_language", "title")


def _enriched(spark, sf_dir):
    return ingest.feed_enrich(ingest.titled(fx.feed_entries(spark, sf_dir)), fx.feeds(spark, sf_dir))


def _built(spark, sf_dir):
    return ingest.article_build(_enriched(spark, sf_dir))


@query("article_build")
def q_article_build(spark, sf_dir):
    return _built(spark, sf_dir)


@query("feed_counts")
def q_feed_counts(spark, sf_dir):
    return _built(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# --- similarity and clustering ------------------------------------------------
from framelens.operators import components, similarity, tfidf  # noqa: E402
from framelens.schema import DBSCAN_EPS, DBSCAN_MIN_SAMPLES  # noqa: E402

DENSE_EPS = 0.60  # the given embeddings are near-orthogonal: 0 pairs at 0.40


def _doc_vectors(spark, sf_dir):
    return tfidf.tfidf(fx.table(spark, sf_dir, "documents"), "doc_id", "text")


def text_neighbours(packed):
    """(classes of equal vectors, edges between their representatives), from stored packed vectors."""
    classes = stored(similarity.packed_classes(packed), "classes")
    return classes, similarity.packed_similarity_join(tfidf.weighted(packed), DBSCAN_EPS, classes.where("id = rep").select("id"))


def text_clusters(packed, docs, min_samples=DBSCAN_MIN_SAMPLES, id_col="id"):
    """(classes, edges, labels) of DBSCAN over the texts' vectors."""
    classes, edges = text_neighbours(packed)
    edges = stored(edges, "edges")
    return classes, edges, components.dbscan(docs, edges, min_samples, id_col=id_col, members=classes)


def _packed_docs(spark, sf_dir):
    checkpoint_dir(spark)
    return stored(tfidf.packed_tfidf(fx.table(spark, sf_dir, "documents"), "doc_id", "text"), "vectors")


def _doc_clusters(spark, sf_dir, min_samples=DBSCAN_MIN_SAMPLES):
    return text_clusters(_packed_docs(spark, sf_dir), fx.table(spark, sf_dir, "documents"), min_samples, "doc_id")


@query("text_vectors")
def q_text_vectors(spark, sf_dir):
    vec = tfidf.tfidf(fx.table(spark, sf_dir, "documents"), "doc_id", "text", hashed=False)
    return vec.select(
        F.col("id").alias("doc_id"), "token", "tf", "df", F.round("w", 6).alias("w"))


@query("similar_pairs")
def q_similar_pairs(spark, sf_dir):
    """Pairs between the representatives of equal vectors; ``similar_classes`` has the membership."""
    _, edges = text_neighbours(_packed_docs(spark, sf_dir))
    return edges.select("src", "dst", F.round("dist", 6).alias("dist"))


@query("similar_classes")
def q_similar_classes(spark, sf_dir):
    return similarity.vector_classes(_doc_vectors(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("event_labels")
def q_event_labels(spark, sf_dir):
    lab = _doc_clusters(spark, sf_dir)[2]
    return lab.withColumnRenamed("id", "doc_id")


def cluster_stats(labels, edges, classes):
    """(n_edges, n_clusters, n_noise, largest_cluster) in one global aggregate.
    The links among copies are counted from the class sizes."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("cnt")).select(
        "label", "cnt", F.lit(0).cast("long").alias("e"))
    reps = classes.where("id = rep").select("id", "n")
    across = (edges.join(reps.toDF("src", "a"), "src").join(reps.toDF("dst", "b"), "dst")
              .select((F.col("a") * F.col("b")).alias("e")))
    within = reps.where("n > 1").select(F.expr("n * (n - 1) div 2").alias("e"))
    ones = across.unionByName(within).select(
        F.lit(None).cast("long").alias("label"), F.lit(0).cast("long").alias("cnt"), "e")
    return sizes.unionByName(ones).agg(
        F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("n_edges"),
        F.count_if(F.col("label") >= 0).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("label") == -1, F.col("cnt"))), F.lit(0)).cast("long").alias("n_noise"),
        F.coalesce(F.max(F.when(F.col("label") >= 0, F.col("cnt"))), F.lit(0)).cast("long")
        .alias("largest_cluster"))


@query("cluster_stats")
def q_cluster_stats(spark, sf_dir):
    classes, edges, lab = _doc_clusters(spark, sf_dir)
    return cluster_stats(lab, edges, classes)


@query("dbscan_general")
def q_dbscan_general(spark, sf_dir):
    lab = _doc_clusters(spark, sf_dir, min_samples=3)[2]
    return lab.withColumnRenamed("id", "doc_id")


@query("similar_pairs_dense")
def q_similar_pairs_dense(spark, sf_dir):
    e = similarity.dense_similarity_join(fx.table(spark, sf_dir, "embeddings"), DENSE_EPS)
    return e.select("src", "dst", F.round("dist", 6).alias("dist"))


@query("event_labels_dense")
def q_event_labels_dense(spark, sf_dir):
    """Events from given vectors: DBSCAN on the exact dense neighbours."""
    emb = fx.table(spark, sf_dir, "embeddings")
    checkpoint_dir(spark)
    edges = similarity.dense_similarity_join(emb, DENSE_EPS).select("src", "dst").checkpoint()
    return components.dbscan(emb, edges, DBSCAN_MIN_SAMPLES, id_col="vec_id").withColumnRenamed("id", "vec_id")


from framelens.operators.incremental import EventStore  # noqa: E402


@query("event_labels_loads")
def q_event_labels_loads(spark, sf_dir):
    """``event_labels_dense`` kept up to date: the vectors arrive in two loads, odd ids first."""
    emb = fx.table(spark, sf_dir, "embeddings")
    store = EventStore(spark, staging_path(spark, "events"), DENSE_EPS, DBSCAN_MIN_SAMPLES)
    for rest in (1, 0):
        store.load(emb.where(F.pmod("vec_id", F.lit(2)) == rest))
    return store.labels().withColumnRenamed("id", "vec_id")


@query("knn_graph")
def q_knn_graph(spark, sf_dir):
    k = similarity.knn_blocked(fx.table(spark, sf_dir, "embeddings"), 10)
    return k.select(F.col("id").alias("vec_id"), "nbr", F.col("rank").cast("long").alias("rank"),
                    F.round("dist", 6).alias("dist"))


# --- narrative core -----------------------------------------------------------
from framelens.operators import narrative  # noqa: E402


def narrative_rows(spark, classified, embedder=None):
    """Cluster the classified rows (text = full_text else title) and attach
    event keys. ``embedder`` maps (id, text) to (id, v array<double>) and the
    dense join then gives the neighbours; without one they come from TF-IDF.
    Labels are checkpointed: they feed several aggregates."""
    checkpoint_dir(spark)
    docs = classified.select(F.col("row_idx").alias("id"),
                             F.coalesce(F.col("full_text"), F.col("title")).alias("text"))
    # cut points: vectors (read by four branches of the join), edges, labels
    if embedder:
        edges = similarity.dense_similarity_join(embedder(docs).checkpoint(), DBSCAN_EPS, "id", "v").checkpoint()
        labels = components.dbscan(docs, edges, DBSCAN_MIN_SAMPLES, id_col="id").checkpoint()
    else:
        labels = stored(text_clusters(stored(tfidf.packed_tfidf(docs, "id", "text"), "vectors"), docs)[2], "labels")
    return narrative.event_rows(classified, labels)


def _rows(spark, sf_dir):
    return narrative_rows(spark, _classified(spark, sf_dir))


def _flat(deltas, *more):
    return deltas.select(
        *more,
        "event_id", "is_event_cluster", "headline_count", "representative_title",
        F.array_join("sources", "|").alias("sources"), F.array_join("perspectives", "|").alias("perspectives"),
        "dominant_tactic", "agreement_score", "delta_score", "severity_score",
        F.array_join("unique_tactics", "|").alias("unique_tactics"))


@query("narrative_delta")
def q_narrative_delta(spark, sf_dir):
    d = narrative.narrative_delta(_rows(spark, sf_dir))
    return d.select("event_id", "dominant_tactic", "agreement_score", "delta_score", "severity_score",
                    F.array_join("unique_tactics", "|").alias("unique_tactics"))


@query("event_severity")
def q_event_severity(spark, sf_dir):
    d = narrative.narrative_delta(_rows(spark, sf_dir))
    return d.select("event_id", "headline_count", "severity_score", "n_unknown")


@query("framing_map")
def q_framing_map(spark, sf_dir):
    f = narrative.framing_map(_rows(spark, sf_dir))
    return f.select("event_id", "perspective", F.array_join("tactics", "|").alias("tactics"))


@query("events")
def q_events(spark, sf_dir):
    return _flat(narrative.narrative_delta(_rows(spark, sf_dir)))


@query("events_ranked")
def q_events_ranked(spark, sf_dir):
    r = narrative.events_ranked(narrative.narrative_delta(_rows(spark, sf_dir)))
    return r.select("rank", "event_id", "delta_score")


@query("report_meta")
def q_report_meta(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return narrative.report_meta(rows, narrative.narrative_delta(rows))


@query("contested_top")
def q_contested_top(spark, sf_dir):
    return narrative.contested_top(narrative.narrative_delta(_rows(spark, sf_dir)))


@query("tactic_distribution")
def q_tactic_distribution(spark, sf_dir):
    return rollups.histogram(_classified(spark, sf_dir), "tactic_label")


@query("source_distribution")
def q_source_distribution(spark, sf_dir):
    return rollups.histogram(_classified(spark, sf_dir), "source")


@query("event_headlines")
def q_event_headlines(spark, sf_dir):
    return narrative.event_headlines(_rows(spark, sf_dir)).drop("x", "y", "z")


def flagship(spark, sf_dir):
    """The full run: classified rows -> TF-IDF -> exact similarity join ->
    DBSCAN -> narrative deltas -> events in report order."""
    r = narrative.events_ranked(narrative.narrative_delta(_rows(spark, sf_dir)))
    return _flat(r, "rank").orderBy("rank")


# --- inference ------------------------------------------------------------------
from framelens.operators import inference  # noqa: E402


def _parsed(spark, sf_dir, with_quota=False):
    arts = fx.articles(spark, sf_dir)
    n = arts.count()
    ans = fx.llm_answers(spark, sf_dir, with_quota)
    if with_quota:
        ans = inference.quota_cut(ans)
    return arts, inference.parse_answers(ans, n)


@query("llm_parse")
def q_llm_parse(spark, sf_dir):
    return _parsed(spark, sf_dir)[1]


def _classified_out(rows):
    return rows.select("row_idx", "source", "title", "tactic_label", "specific_technique",
                       "tactic_confidence", "llm_reasoning")


@query("classified")
def q_classified(spark, sf_dir):
    arts, parsed = _parsed(spark, sf_dir)
    return _classified_out(inference.merge_answers(arts.select("row_idx", "source", "title"), parsed))


@query("quota_cut")
def q_quota_cut(spark, sf_dir):
    arts, parsed = _parsed(spark, sf_dir, with_quota=True)
    return _classified_out(inference.merge_answers(arts.select("row_idx", "source", "title"), parsed))


def _clean_rows(spark, sf_dir):
    a = ingest.full_text_fallback(ingest.drop_conflicted(fx.articles(spark, sf_dir)))
    return dense_index(a.withColumnRenamed("row_idx", "src_idx"), "src_idx", "row_idx")


@query("classify_batches")
def q_classify_batches(spark, sf_dir):
    b = inference.batch_items(_clean_rows(spark, sf_dir), n_keys=2)
    return b.drop("payload")


@query("lexicon_tactics")
def q_lexicon_tactics(spark, sf_dir):
    rows = _clean_rows(spark, sf_dir).select(
        "row_idx", F.coalesce(F.col("full_text"), F.lit("")).alias("text"))
    return inference.lexicon_tactics(spark, rows)


@query("classify_run")
def q_classify_run(spark, sf_dir):
    rows = _clean_rows(spark, sf_dir)
    n = rows.count()
    checkpoint_dir(spark)
    # stored before it is read: every batch is sent to the model once, and every answer received is used
    runs = inference.run_batches(inference.batch_items(rows), inference.lexicon_model).checkpoint()
    parsed = inference.parse_answers(runs, n)
    out = inference.merge_answers(rows, parsed)
    return out.select("row_idx", "tactic_label", "specific_technique", "tactic_confidence")


from framelens.operators import waves  # noqa: E402


def _day_runs(spark, sf_dir):
    w = waves.Waves(spark, staging_path(spark, "waves"))
    w.plan(inference.batch_items(_clean_rows(spark, sf_dir), n_keys=2), waves.ANSWER_TOKENS)
    return w


_RUN_COLUMNS = ["batch_index", "key_route", "attempts", "status", "tokens", "spent"]


@query("batch_runs")
def q_batch_runs(spark, sf_dir):
    """The status table of a run whose model fails, answers unreadably and ends by its quota, up to that end."""
    runs = _day_runs(spark, sf_dir).run_day(fx.flaky_model)
    return waves.until_stop(runs).select(*_RUN_COLUMNS)


@query("batch_budget")
def q_batch_budget(spark, sf_dir):
    """Two days within the daily budget of tokens a key: the second goes on where the first ended."""
    w = _day_runs(spark, sf_dir)
    for _ in range(2):
        w.run_day([inference.lexicon_model] * 2, waves.TOKENS_PER_DAY)
    return w.runs().select(F.col("day").cast("long").alias("day"), *_RUN_COLUMNS)


from framelens.operators import bayes  # noqa: E402


def _labelled(spark, sf_dir):
    """Documents with their toxic label as text; those whose id is divisible by 4 are held out."""
    labels = fx.table(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("string").alias("label"))
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
    return rows.withColumn("held_out", F.pmod("doc_id", F.lit(4)) == 0)


@query("bayes_labels")
def q_bayes_labels(spark, sf_dir):
    """Labels of the held-out documents by the classifier fitted on the others."""
    rows = _labelled(spark, sf_dir)
    model = bayes.fit_bayes(rows.where("not held_out"))
    return bayes.score_bayes(rows.where("held_out"), model, "doc_id").select(F.col("id").alias("doc_id"), "label", F.round("score", 3).alias("score"))


@query("bayes_accuracy")
def q_bayes_accuracy(spark, sf_dir):
    """Whether the classifier is right more often than the most frequent label on the held-out documents."""
    rows = _labelled(spark, sf_dir)
    model = bayes.fit_bayes(rows.where("not held_out"))
    test = rows.where("held_out").withColumnRenamed("label", "truth")
    both = test.join(bayes.score_bayes(test, model, "doc_id").withColumnRenamed("id", "doc_id"), "doc_id")
    n, hit = F.count(F.lit(1)), F.count_if(F.col("truth") == F.col("label"))
    most = F.greatest(F.count_if(F.col("truth") == "1"), F.count_if(F.col("truth") == "0"))
    return both.agg(n.alias("n"), (hit > most).alias("above_majority"))


# --- pages, feeds, translation -------------------------------------------------
from framelens.functions.text import py_strip  # noqa: E402
from framelens.sources import feeds as feedsrc  # noqa: E402
from framelens.sources import pages as pagesrc  # noqa: E402


@query("page_bodies")
def q_page_bodies(spark, sf_dir):
    pg = fx.table(spark, sf_dir, "pages")
    return pagesrc.page_bodies(pg, max_chars=None).select("page_id", "url", "body")


def _feed_docs(spark, sf_dir):
    """Landed RSS documents built from the feed entries, plus one malformed
    document per run (a truncated copy of the first page of src0)."""
    docs = feedsrc.feed_documents(fx.feed_entries(spark, sf_dir))
    bad = docs.where((F.col("source") == "src0") & (F.col("page") == 0)).select(
        F.lit("src0-broken").alias("source"), "page",
        F.substring("xml", 1, F.floor(F.length("xml") / 2).cast("int")).alias("xml"))
    return docs.unionByName(bad)


@query("feed_entries")
def q_feed_entries(spark, sf_dir):
    e = feedsrc.parse_feeds(_feed_docs(spark, sf_dir))
    return e.select("source", "page", "item", py_strip("title").alias("title"),
                    py_strip(F.coalesce("summary", F.lit(""))).alias("summary"),
                    F.coalesce("link", F.lit("")).alias("link"), "published")


@query("translate_route")
def q_translate_route(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    t = ingest.translate_route(F.col("text"), F.col("lang"))
    return d.select("doc_id", "lang", F.length(t).alias("n_chars"), F.md5(t).alias("md5"))


from framelens.operators.translate import translate_texts  # noqa: E402


@query("translate_batches")
def q_translate_batches(spark, sf_dir):
    """All documents through a batched translator (here one that marks every piece), a second time from the memo alone."""
    memo = Snapshots(spark, staging_path(spark, "memo"))
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")

    def mark(pieces, lang):
        return [f"<{lang}>{p}" for p in pieces]

    def none_left(pieces, lang):
        raise RuntimeError("every piece stands in the memo")

    translate_texts(docs, mark, memo, "doc_id")
    t = translate_texts(docs, none_left, memo, "doc_id")
    return t.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"), "n_failed")


@query("translate_preview")
def q_translate_preview(spark, sf_dir):
    b = _built(spark, sf_dir).where(F.col("original_language") != "en")
    top = b.orderBy("source", "pos").limit(3)
    return top.select("source", F.substring("raw_title", 1, 80).alias("original"),
                      F.substring("title", 1, 80).alias("translated"),
                      F.substring("full_text", 1, 150).alias("full_text"))


# --- map, phrases, report, streams ----------------------------------------------
from framelens.operators import phrases, projection  # noqa: E402
from framelens.sources import report as reportsrc  # noqa: E402
from framelens.streaming import jobs as streams  # noqa: E402


@query("map_coords")
def q_map_coords(spark, sf_dir):
    coords, _ = projection.pca_coordinates(fx.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return coords.withColumnRenamed("id", "vec_id")


@query("fuzzy_graph")
def q_fuzzy_graph(spark, sf_dir):
    knn = similarity.knn_blocked(fx.table(spark, sf_dir, "embeddings"), 10)
    return projection.fuzzy_graph(knn, 10)


from framelens.operators import layout, nndescent  # noqa: E402


@query("knn_descent_recall")
def q_knn_descent_recall(spark, sf_dir):
    """Entries of the exact neighbour lists, and whether neighbour descent finds at least 90% of them."""
    emb = fx.table(spark, sf_dir, "embeddings")
    found = nndescent.knn_descent(emb, 10)
    r = nndescent.recall_of(found, similarity.knn_blocked(emb, 10))
    return r.select("n", (F.col("hit") * 10 >= F.col("n") * 9).alias("recall_ok"))


def map_layouts(spark, emb, k=10, epochs=10):
    """(knn, fuzzy graph, spectral, forces): the neighbour lists by descent, and the map from their fuzzy graph."""
    checkpoint_dir(spark)
    knn = nndescent.knn_descent(emb, k).checkpoint()
    graph = projection.fuzzy_graph(knn, k).checkpoint()
    spectral, _ = layout.spectral_layout(graph)
    return knn, graph, spectral, layout.force_layout(graph, spectral, epochs)


@query("map_layout")
def q_map_layout(spark, sf_dir):
    return map_layouts(spark, fx.table(spark, sf_dir, "embeddings"))[3].withColumnRenamed("id", "vec_id")


@query("map_quality")
def q_map_quality(spark, sf_dir):
    """Facts of the two layouts that no sign or rotation changes: the spectral axes are orthonormal within 1e-6 and
    keep three times as many neighbours as chance would (k of n - 1 others); the forces keep more than they do."""
    knn, _, spectral, forces = map_layouts(spark, fx.table(spark, sf_dir, "embeddings"))
    forces = forces.checkpoint()
    p = layout.axis_products(spectral)
    unit = F.greatest(*[F.abs(F.col(a + a) - 1) for a in layout.AXES], F.abs("xy"), F.abs("xz"), F.abs("yz")) < 1e-6
    exact = similarity.knn_blocked
    a = layout.neighbours_kept(knn, spectral, 10, exact).toDF("n_a", "kept_a")
    b = layout.neighbours_kept(knn, forces, 10, exact).toDF("n_b", "kept_b")
    size = forces.agg(F.count(F.lit(1)).alias("n_points"))
    one = p.crossJoin(a).crossJoin(b).crossJoin(size)  # four tables of one row
    chance = F.lit(10.0) / (F.col("n_points") - 1)
    return one.select("n_points", unit.alias("orthonormal"), (F.col("kept_a") / F.col("n_a") > 3 * chance).alias("above_chance"),
                      (F.col("kept_b") > F.col("kept_a")).alias("forces_better"))


@query("similar_pairs_lsh")
def q_similar_pairs_lsh(spark, sf_dir):
    e = similarity.lsh_candidates(fx.table(spark, sf_dir, "embeddings"), DENSE_EPS)
    return e.select("src", "dst", F.round("dist", 6).alias("dist"))


@query("lsh_recall")
def q_lsh_recall(spark, sf_dir):
    """Pairs of the exact dense join, and whether the LSH mode finds at least 95% of them and no other."""
    emb = fx.table(spark, sf_dir, "embeddings")
    exact = similarity.dense_similarity_join(emb, DENSE_EPS).select("src", "dst", F.lit(1).alias("e"))
    found = similarity.lsh_candidates(emb, DENSE_EPS).select("src", "dst", F.lit(1).alias("f"))
    both = exact.join(found, ["src", "dst"], "full_outer").agg(
        F.count("e").alias("n_pairs"), F.count_if(F.col("e").isNull()).alias("n_false"),
        F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("hit"))
    return both.select("n_pairs", "n_false", (F.col("hit") * 20 >= F.col("n_pairs") * 19).alias("recall_ok"))


@query("key_phrase")
def q_key_phrase(spark, sf_dir):
    k = phrases.key_phrases(fx.table(spark, sf_dir, "documents"))
    return k.withColumnRenamed("id", "doc_id")


RUN_TS = "2025-12-01T08:00:00"


def narrative_rows_with_coords(spark, classified):
    """Rows with event keys and 3D coordinates (TF-IDF hashed to 64 dims,
    then PCA(3)); coordinates are attached by an equi-join on row_idx."""
    docs = classified.select(F.col("row_idx").alias("id"),
                             F.coalesce(F.col("full_text"), F.col("title")).alias("text"))
    checkpoint_dir(spark)
    vec = stored(tfidf.packed_tfidf(docs, "id", "text", slots=64), "vectors")
    labels = stored(text_clusters(vec, docs)[2], "labels")
    coords, _ = projection.pca_coordinates(vec.select("id", "v"), "id", "v")
    with_xyz = classified.join(coords.withColumnRenamed("id", "row_idx"), "row_idx", "left")
    return narrative.event_rows(with_xyz, labels)


def write_report(spark, sf_dir, path):
    rows = narrative_rows_with_coords(spark, _classified(spark, sf_dir)).checkpoint()
    deltas = narrative.narrative_delta(rows)
    ranked = narrative.events_ranked(deltas)
    fm = narrative.framing_map_nested(rows)
    events = ranked.join(fm, "event_id").select(
        "event_id", "is_event_cluster", "headline_count", "representative_title", "sources", "perspectives",
        F.struct("dominant_tactic", "agreement_score", "delta_score", "severity_score", "unique_tactics",
                 "framing_map").alias("narrative_delta"), "rank")
    meta = narrative.report_meta(rows, deltas, with_distributions=True)
    reportsrc.export_report(meta, events, narrative.event_headlines(rows), path, RUN_TS)


@query("narratives")
def q_narratives(spark, sf_dir):
    path = staging_path(spark, "report")
    write_report(spark, sf_dir, path)
    _, events, _ = reportsrc.narratives(spark, path)
    nd = "narrative_delta"
    framing = F.transform(F.map_entries(f"{nd}.framing_map"),
                          lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return events.select(
        "rank", F.array_join(F.array_sort(framing), ";").alias("framing_map"),
        "event_id", "is_event_cluster", "headline_count", "representative_title",
        F.array_join("sources", "|").alias("sources"), F.array_join("perspectives", "|").alias("perspectives"),
        F.col(f"{nd}.dominant_tactic").alias("dominant_tactic"),
        F.col(f"{nd}.agreement_score").alias("agreement_score"),
        F.col(f"{nd}.delta_score").alias("delta_score"), F.col(f"{nd}.severity_score").alias("severity_score"),
        F.array_join(f"{nd}.unique_tactics", "|").alias("unique_tactics"))


FETCH_BASE = "2025-12-01 00:00:00"


def _landed_files(spark):
    """Files of a landed batch: as many as the session has shuffle partitions, so that a task's share does not grow with the input."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("articles_stream")
def q_articles_stream(spark, sf_dir):
    """Raw articles landed as files (fetch time = base + doc_id minutes; the
    50 repeats of fixture file C land again an hour later), deduped on
    (title, source) by the stream."""
    base = staging_path(spark, "stream-articles")
    r = fx.raw_articles(spark, sf_dir)
    ts = F.date_format(F.to_timestamp_ntz(F.lit(FETCH_BASE)) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.col("doc_id").cast("int"), F.lit(0)), "yyyy-MM-dd HH:mm:ss")
    landed = r.withColumn("fetch_timestamp", ts)
    rep = landed.where(F.col("doc_id") < 3 * fx.REPEATS).where(F.col("doc_id") % 3 == 0).withColumn(
        "fetch_timestamp", F.date_format(F.to_timestamp_ntz("fetch_timestamp") + F.expr("INTERVAL 1 HOUR"),
                                         "yyyy-MM-dd HH:mm:ss"))
    landed.unionByName(rep).drop("doc_id").repartition(_landed_files(spark)).write.parquet(f"{base}/landed")
    q = streams.articles_stream(spark, f"{base}/landed", f"{base}/sink", f"{base}/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/sink")
    return out.select("source", "title")


@query("tactic_counts_stream")
def q_tactic_counts_stream(spark, sf_dir):
    base = staging_path(spark, "stream-counts")
    ev = fx.table(spark, sf_dir, "events")
    ev.repartition(_landed_files(spark)).write.parquet(f"{base}/landed")
    q = streams.tactic_counts_stream(spark, f"{base}/landed", ev.schema, f"{base}/sink", f"{base}/ckpt")
    q.awaitTermination()
    c = streams.latest_counts(spark, f"{base}/sink")
    return c.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "label", "n")
