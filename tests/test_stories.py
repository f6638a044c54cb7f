"""Story detection: tokens, clustering, topics, follow-ups, scores and choices on small cases."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from tidewire.functions import text, urls, values
from tidewire.operators import followup, scoring, selection, topics
from tidewire.operators.cluster import leader_clusters
from tidewire.operators.terms import headline_documents

DAY = datetime(2026, 4, 27, 8)


def articles(spark, titles, source_type=1, day=DAY):
    rows = []
    for i, (title, source) in enumerate(titles):
        at = day + timedelta(minutes=i)
        rows.append((i, 1000 + i, f"https://example.com/{source}/{i}", f"https://{source}.example.com/feed.xml", source, title, None, at, at, source_type, day.date()))
    schema = "seq long, url_hash long, url string, feed_url string, feed_title string, title string, summary string, published_at timestamp, fetched_at timestamp, source_type int, day date"
    return spark.createDataFrame(rows, schema)


def stems(spark, line):
    return spark.range(1).select(F.transform(text.tokens(F.lit(line)), lambda t: t["stem"]).alias("s")).first().s


def test_normalises_headlines(spark):
    assert stems(spark, "OpenAI launches new reasoning models in Europe!") == ["openai", "launch", "reason", "model", "europe"]
    french = stems(spark, "La France prohíbe las redes sociales à des menores de 15 años")
    assert "prohibe" in french and not {"la", "de", "des", "15"} & set(french)


def test_normalises_like_unicode(spark):
    """Composed and decomposed headlines are one; every script's letters fold as Unicode says."""
    import re
    import unicodedata

    lines = ["Élection à São Paulo: prohíbe yoğurt", "Россия объявила йогурт", "서울 집 값", "ﬁnance ǆ Ⅷ ½ ①② ﷺ", "Tiếng Việt ệ x\u0301y", "ΟΔΟΣ ά ὕδωρ", "日本語 ﾊﾝｶｸ ガギ"]
    lines += [unicodedata.normalize("NFD", x) for x in lines]

    def plain(line):
        words = [w for w in re.split(r"[\W_]+", re.sub(r"['’]s\b", "", unicodedata.normalize("NFC", line).lower())) if w]
        keys = ["".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.category(c).startswith("M")) for w in words]
        return [k for k in keys if len(k) > 1 and k not in text.STOPWORDS and not re.fullmatch("[0-9]+", k)]

    for line in lines:
        if "\u0301y" in line:
            continue  # Python's \w takes a lone mark for a word character
        got = spark.range(1).select(F.transform(text.tokens(F.lit(line)), lambda t: t["stem"]).alias("s")).first().s
        want = [k for k in plain(line)]
        assert [g for g in got] == [spark.range(1).select(text.stem(F.lit(w))).first()[0] for w in want], line
    assert stems(spark, lines[0]) == stems(spark, lines[7])
    forms = spark.range(1).select(F.transform(text.tokens(F.lit(lines[7])), lambda t: t["surface"]).alias("s")).first().s
    assert "élection" in forms


def test_terms_hold_pairs(spark):
    found = spark.range(1).select(text.terms(F.transform(text.tokens(F.lit("OpenAI launches reasoning model in Europe")), lambda t: t["stem"])).alias("t")).first().t
    assert {"openai launch", "reason model"} <= set(found)


def test_leader_clustering_sizes():
    found = leader_clusters([{"a": 1.0, "b": 1.0}, {"a": 1.0, "b": 0.9}, {"c": 1.0}], 0.5)
    assert sorted(map(len, found)) == [1, 2]
    assert leader_clusters([{}, {"a": 1.0}], 0.3) == [[1]]


def test_identical_headlines_are_one_story(spark):
    rows = articles(spark, [("Volcano erupts near the old capital city", s) for s in ("one", "two", "three")])
    (topic,) = topics.stories(rows).collect()
    assert (topic.article_count, topic.unique_source_count, len(topic.sample_headlines)) == (3, 3, 1)


def test_two_stories_stay_apart(spark):
    war = ["White House sends new aid package to Ukraine", "White House announces aid package for Ukraine", "White House aid package to Ukraine announced"]
    hall = ["White House ballroom construction begins with demolition", "Demolition begins for White House ballroom construction", "White House ballroom construction demolition begins today"]
    rows = articles(spark, [(t, f"s{i}") for i, t in enumerate(war + hall)])
    assert sorted(r.article_count for r in topics.stories(rows).collect()) == [3, 3]


def test_labels_keep_surface_forms(spark):
    lines = ["Bill Gates testifies about Epstein meetings before Congress", "Gates testifies on Epstein meetings before Congress panel", "Gates and Epstein meetings: Gates testifies before Congress"]
    (topic,) = topics.stories(articles(spark, [(t, f"s{i}") for i, t in enumerate(lines)])).collect()
    assert "gates" in topic.label_keywords and "gat" not in topic.label_keywords
    assert len(topic.headline.split()) >= 5


def test_videos_one_a_channel(spark):
    fire = [("Huge fire destroys historic market hall", f"s{i}") for i in range(3)]
    rows = articles(spark, fire)
    made = topics.stories(rows)
    clips = articles(spark, [("Huge fire destroys market hall | Chan A", "a"), ("Market hall fire destroys hall | Chan A", "a"), ("Fire destroys historic market | Chan B", "b"), ("Google myself", "c")], 2)
    (got,) = topics.attach_videos(made, clips, headline_documents(rows)).collect()
    assert len(got.video_hashes) == 2


def test_status_and_burst(spark):
    def status(similarity, novelty, z, burst):
        return spark.range(1).select(scoring.status(*map(F.lit, (similarity, novelty, z, burst))).alias("s")).first().s

    assert [status(0.0, 1.0, 3.0, 1.0), status(0.5, 0.5, 2.5, 0.9), status(0.5, 0.5, 0.1, 0.1), status(0.35, 0.65, 0.1, 0.1)] == ["new", "trending", "ongoing", "monitor"]
    z = spark.range(1).select(scoring.burst(F.lit(5), F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("z")).first().z
    assert z == 3.0


def test_follow_up_anchor(spark):
    today = headline_documents(articles(spark, [("Skerritt defends policy in parliament", "a"), *[(f"Unrelated matter number word{i} here", f"s{i}") for i in range(4)]]))
    story = [(1, "t1", ["Skerritt", "tom", "elections"], ["Tom Skerritt wins elections", "Skerritt wins island elections", "Skerritt elections victory"], ["Tom Skerritt"], {"skerritt": 1.0, "tom": 0.5, "election": 0.4, "parliament": 0.3})]
    schema = "ordinal int, id string, label_keywords array<string>, sample_headlines array<string>, entities array<string>, centroid_vector map<string,double>"
    base = spark.createDataFrame([(f"Ordinary headline number {i} about weather and markets",) for i in range(30)], "title string")
    (anchor,) = followup.anchors(spark.createDataFrame(story, schema), today, base).collect()
    assert anchor.stem == "skerritt" and "tom" not in anchor.context and "parliament" in anchor.context
    assert followup.anchors(spark.createDataFrame(story, schema), today, base.limit(0)).count() == 0


def pool(spark, rows):
    return spark.createDataFrame([(date(2026, 1, 1), i + 1, *r) for i, r in enumerate(rows)], "day date, place int, id string, final_score double, section string")


def balanced(candidates):
    """The rule as a plain loop."""
    from tidewire.config import DEFAULTS as d
    from tidewire.config import SOFT_MINIMUM_SECTIONS

    picked, per = [], {}

    def take(c):
        picked.append(c.id)
        per[c.section] = per.get(c.section, 0) + 1

    for s in SOFT_MINIMUM_SECTIONS:
        best = next((c for c in candidates if c.section == s), None)
        if best and best.final_score >= candidates[0].final_score * d.soft_minimum_score and len(picked) < d.max_topics:
            take(best)
    for c in candidates:
        if len(picked) < d.max_topics and c.id not in picked and per.get(c.section, 0) < d.per_section:
            take(c)
    for c in candidates:
        if len(picked) < d.min_topics and c.id not in picked:
            take(c)
    return [c.id for c in candidates if c.id in picked]


def test_balanced_selection(spark):
    cases = [
        [(f"w{i}", 1 - i / 100, "world") for i in range(8)] + [("p1", 0.5, "politics"), ("t1", 0.6, "technology")],
        [(f"w{i}", 1 - i / 100, "world") for i in range(20)] + [(f"{s}{i}", 0.7 - i / 10, s) for s in ("technology", "sports", "culture", "politics") for i in range(4)],
        [(f"w{i}", 1 - i / 100, "world") for i in range(9)],
    ]
    for rows in cases:
        rows = sorted(rows, key=lambda r: -r[1])
        got = [r.id for r in selection.select_balanced(pool(spark, rows)).orderBy("place").collect()]
        assert got == balanced([SimpleNamespace(id=a, final_score=b, section=c) for a, b, c in rows])


def test_pick_articles_is_greedy_on_both_keys(spark):
    rows = [("t", i, None, title, source, source, f"u{i}") for i, (title, source) in enumerate([("A b", "x"), ("A  b!", "y"), ("C", "x"), ("D", "y"), ("E", "z"), ("F", "w"), ("G", "v"), ("H", "q")])]
    df = spark.createDataFrame(rows, "id string, seq int, rank int, title string, feed_title string, feed_url string, url string")
    (got,) = selection.pick_articles(df).collect()
    assert [a.url for a in got.articles] == ["u0", "u3", "u4", "u5", "u6"]


def test_urls(spark):
    cases = {
        "https://www.youtube.com/watch?v=AbC123&list=x": ("https://www.youtube.com/watch?v=AbC123", "AbC123"),
        "https://Example.com/Article/?utm_source=x#y": ("https://example.com/article", None),
        "http://www.bbc.com/news/articles/c1?x=1": ("https://www.bbc.com/news/articles/c1", None),
        "https://youtu.be/xyz": ("https://youtu.be/xyz", "xyz"),
        "https://www.youtube.com/shorts/s-1": ("https://www.youtube.com/shorts/s-1", "s-1"),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.normalize(F.col("u")).alias("n"), urls.video_id(F.col("u")).alias("v")).collect()
    assert {r.u: (r.n, r.v) for r in rows} == cases


def test_values(spark):
    row = spark.range(1).select(
        values.clamp01(F.lit(float("nan"))).alias("nan"), values.fnv1a(F.lit("a")).alias("fnv"), values.parse_time(F.lit("Mon, 27 Apr 2026 08:00:00 +0000")).alias("t"),
        text.clean_text(F.lit("<b>a</b>&amp;quot;<script>x</script> &nbsp;b")).alias("c"), text.decode_entities(F.lit("&#x41;&#66;&amp;lt;")).alias("d"),
    ).first()
    assert (row.nan, row.fnv, row.c, row.d) == (0.0, 0xE40C292C, "a &quot;  b", "AB<")
    assert row.t == datetime(2026, 4, 27, 8)
