"""Stories of a day: centroids, central documents, labels, entities, themes and attached videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.config import DEFAULTS, Settings
from tidewire.functions import text, values
from tidewire.operators.cluster import cluster_days
from tidewire.operators.terms import headline_documents, tfidf, vectors
from tidewire.storage import materialise


def _first_seen(cells: Column, n: int | None = None) -> Column:
    out = F.array_distinct(F.filter(cells, lambda x: x.isNotNull() & (x != "")))
    return out if n is None else F.slice(out, 1, n)


def centroids(members: DataFrame, long: DataFrame, n: int, by: str = "day") -> DataFrame:
    """(by, cluster, term, weight, rank): mean vectors, their n strongest terms; ties go to the term met first."""
    sizes = members.groupBy(by, "cluster").agg(F.count("*").alias("size"))
    cells = members.join(long, [by, "doc_id"]).groupBy(by, "cluster", "term").agg(
        F.sum("weight").alias("total"), F.min(F.struct("position", "term_at")).alias("seen")
    )
    mean = cells.join(sizes, [by, "cluster"]).select(by, "cluster", "term", "seen", F.round(F.col("total") / F.col("size"), 12).alias("weight"))
    order = Window.partitionBy(by, "cluster").orderBy(F.desc("weight"), "seen")
    return mean.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("seen")


def central_documents(members: DataFrame, long: DataFrame, centre: DataFrame, documents: DataFrame, by: str = "day") -> DataFrame:
    """Members with `central`: 1 for the most similar to the centroid; then by copies, then by order."""
    norms = centre.groupBy(by, "cluster").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    own = members.join(long, [by, "doc_id"])
    near = own.withColumnRenamed("weight", "own").join(centre, [by, "cluster", "term"], "left")
    near = near.groupBy(by, "cluster", "doc_id", "position").agg(
        F.coalesce(F.sum(F.col("own") * F.col("weight")), F.lit(0.0)).alias("dot"), F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("own_norm")
    )
    near = near.join(norms, [by, "cluster"]).withColumn("similarity", F.round(F.col("dot") / (F.col("norm") * F.col("own_norm")), 12))
    near = near.join(documents, [by, "doc_id"])
    order = Window.partitionBy(by, "cluster").orderBy(F.desc("similarity"), F.desc(F.size("copies")), "position")
    return near.withColumn("central", F.row_number().over(order))


def labels(centre: DataFrame, members: DataFrame, documents: DataFrame, n: int, by: str = "day") -> DataFrame:
    """(by, cluster, label_keywords): strongest single words in their most common surface form."""
    words = centre.where(~F.col("term").contains(" "))
    words = words.withColumn("word_rank", F.row_number().over(Window.partitionBy(by, "cluster").orderBy("rank"))).where(F.col("word_rank") <= n)
    forms = members.join(documents, [by, "doc_id"]).select(by, "cluster", "position", F.size("copies").alias("weight"), F.posexplode("surfaces").alias("at", "cell"))
    forms = forms.groupBy(by, "cluster", F.col("cell.term").alias("term"), F.col("cell.surface").alias("surface")).agg(F.sum("weight").alias("count"), F.min(F.struct("position", "at")).alias("seen"))
    best = forms.withColumn("form_rank", F.row_number().over(Window.partitionBy(by, "cluster", "term").orderBy(F.desc("count"), "seen"))).where("form_rank = 1")
    shown = words.join(best.select(by, "cluster", "term", "surface"), [by, "cluster", "term"], "left")
    cells = F.array_sort(F.collect_list(F.struct("word_rank", F.coalesce("surface", "term").alias("word"))))
    return shown.groupBy(by, "cluster").agg(_first_seen(F.transform(cells, lambda c: c["word"])).alias("label_keywords"))


def build_topics(members: DataFrame, long: DataFrame, documents: DataFrame, settings: Settings = DEFAULTS, by: str = "day") -> DataFrame:
    """One row a cluster that is large enough and covered by enough sources."""
    centre = materialise(centroids(members, long, settings.centroid_terms, by))
    ranked = central_documents(members, long, centre, documents, by)
    gathered = ranked.groupBy(by, "cluster").agg(F.array_sort(F.collect_list(F.struct("central", "title", "copies"))).alias("docs"))
    copies = F.flatten(F.transform("docs", lambda d: d["copies"]))
    gathered = gathered.withColumn("articles", copies).withColumn("titles", _first_seen(F.transform("docs", lambda d: d["title"])))
    source = lambda a: F.coalesce(F.nullif(a["feed_url"], F.lit("")), F.nullif(a["feed_title"], F.lit("")), F.lit("unknown"))
    name = lambda a: F.coalesce(F.nullif(a["feed_title"], F.lit("")), F.nullif(a["feed_url"], F.lit("")), F.lit("unknown"))
    lead = F.coalesce(F.get(F.filter("titles", lambda t: F.size(F.split(t, r"\s+")) >= 5), F.lit(0)), F.get("titles", F.lit(0)))
    topics = gathered.select(
        by, "cluster", F.size("articles").cast("long").alias("article_count"), F.size(F.array_distinct(F.transform("articles", source))).cast("long").alias("unique_source_count"),
        F.transform("articles", lambda a: a["url_hash"]).alias("article_hashes"), _first_seen(F.flatten(F.transform("titles", text.entities)), 12).alias("entities"),
        F.slice(F.concat(F.array(lead), F.filter("titles", lambda t: t != lead)), 1, settings.sample_headlines).alias("sample_headlines"),
        _first_seen(F.transform("articles", name), 5).alias("top_sources"), F.array_sort(F.array_distinct(F.transform("articles", lambda a: values.part_of_day(a["at"])))).alias("active_windows"),
    )
    topics = topics.where((F.col("article_count") >= settings.min_topic_size) & (F.col("unique_source_count") >= settings.min_sources))
    shown = labels(centre, members, documents, settings.label_words, by)
    vector = centre.groupBy(by, "cluster").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "weight"))), lambda c: F.struct(c["term"], c["weight"]))).alias("centroid_vector"))
    topics = topics.join(shown, [by, "cluster"]).join(vector, [by, "cluster"])
    spelled = F.concat(F.array_join("label_keywords", "|"), F.lit("|"), F.array_join(F.array_sort("article_hashes"), "|"))
    return topics.withColumn("id", values.hex_id("topic_", spelled)).withColumn("headline", F.get("sample_headlines", F.lit(0)))


def themes(topics: DataFrame, settings: Settings = DEFAULTS, by: str = "day") -> DataFrame:
    """Topics with theme_id and theme_label: the same clustering over their centroids."""
    flat = topics.select(
        by, F.col("id").alias("doc_id"), "cluster", F.map_keys("centroid_vector").alias("vector_terms"), F.map_values("centroid_vector").alias("vector_weights")
    )
    grouped = cluster_days(flat, ["cluster", "doc_id"], settings.theme_similarity, settings, by).withColumnRenamed("doc_id", "id").withColumnRenamed("cluster", "theme")
    ids = grouped.groupBy(by, "theme").agg(values.hex_id("theme_", F.array_join(F.array_sort(F.collect_list("id")), "|")).alias("theme_id"), F.count("*").alias("size"))
    words = grouped.join(topics.select(by, "id", "centroid_vector"), [by, "id"]).select(by, "theme", "position", F.posexplode("centroid_vector").alias("at", "term", "weight"))
    words = words.where(~F.col("term").contains(" ")).groupBy(by, "theme", "term").agg(F.round(F.sum("weight"), 12).alias("weight"), F.min(F.struct("position", "at")).alias("seen"))
    words = words.withColumn("r", F.row_number().over(Window.partitionBy(by, "theme").orderBy(F.desc("weight"), "seen"))).where("r <= 4")
    label = words.groupBy(by, "theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda c: c["term"]).alias("theme_label"))
    return topics.join(grouped.join(ids, [by, "theme"]).join(label, [by, "theme"]).select(by, "id", "theme_id", "theme_label"), [by, "id"], "left")


def attach_videos(topics: DataFrame, videos: DataFrame, documents: DataFrame, settings: Settings = DEFAULTS, by: str = "day") -> DataFrame:
    """(by, id, video_hashes): each video goes to its most similar topic, by its title or title and description, if it
    shares enough words; a topic keeps its best, one a channel. Topics themselves never change."""
    title = text.strip_channel(F.col("title"))
    both = F.concat(title, F.lit(" "), F.substring(F.coalesce(F.col("summary"), F.lit("")), 1, 200))
    forms = videos.where(title != "").select(by, "url_hash", F.col("seq"), F.coalesce("feed_url", "feed_title").alias("channel"), F.posexplode(F.array(title, both)).alias("form", "form_text"))
    stems = F.transform(text.tokens(F.col("form_text")), lambda t: t["stem"])
    docs = forms.select(by, F.concat_ws(":", F.col("seq"), F.col("form")).alias("doc_id"), "url_hash", "seq", "channel", text.terms(stems).alias("terms")).where(F.size("terms") > 0)
    long = tfidf(docs, by, documents)
    norms = long.groupBy(by, "doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("video_norm"))
    centre = topics.select(by, "id", "cluster", values.norm(F.col("centroid_vector")).alias("topic_norm"), F.explode("centroid_vector").alias("term", "topic_weight"))
    hits = long.join(centre, [by, "term"]).groupBy(by, "doc_id", "id", "cluster", "topic_norm").agg(
        F.sum(F.col("weight") * F.col("topic_weight")).alias("dot"), F.count_if(~F.col("term").contains(" ")).alias("shared")
    )
    hits = hits.join(norms, [by, "doc_id"]).join(docs.select(by, "doc_id", "url_hash", "seq", "channel"), [by, "doc_id"])
    hits = hits.withColumn("similarity", F.round(F.col("dot") / (F.col("topic_norm") * F.col("video_norm")), 12))
    hits = hits.where((F.col("shared") >= settings.video_shared_words) & (F.col("similarity") >= settings.video_similarity))
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy(by, "seq").orderBy(F.desc("similarity"), "cluster"))).where("r = 1")
    channel = best.withColumn("c", F.row_number().over(Window.partitionBy(by, "id", "channel").orderBy(F.desc("similarity"), "seq"))).where("c = 1")
    kept = channel.withColumn("k", F.row_number().over(Window.partitionBy(by, "id").orderBy(F.desc("similarity"), "seq"))).where(F.col("k") <= settings.videos_per_topic)
    cells = F.array_sort(F.collect_list(F.struct("k", F.col("url_hash").cast("string").alias("hash"))))
    return kept.groupBy(by, "id").agg(F.transform(cells, lambda c: c["hash"]).alias("video_hashes"))


def stories(articles: DataFrame, settings: Settings = DEFAULTS, by: str = "day") -> DataFrame:
    """All days' stories from their articles: documents, vectors, clusters, topics and themes."""
    documents = materialise(headline_documents(articles, by))  # every later step reads it, as it does the vectors and members
    long = materialise(tfidf(documents, by))
    packed = vectors(long, by).join(documents.select(by, "doc_id", "at", F.get("copies", F.lit(0))["scan"].alias("scan")), [by, "doc_id"])
    order = Window.partitionBy(by).orderBy("at", "scan")
    packed = packed.withColumn("ordinal", F.row_number().over(order))
    members = materialise(cluster_days(packed, ["ordinal"], settings.headline_similarity, settings, by))
    topics = materialise(build_topics(members, long, documents, settings, by))
    return themes(topics, settings, by)
