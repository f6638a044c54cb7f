"""Feed administration: categories by address, merging of feed lists, liveness and pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.functions import urls


# What an address says about a feed's category and language, first match wins.
CATEGORY_RULES = (
    (r"youtube\.com/feeds/videos\.xml", "youtube", "en"),
    (r"arxiv\.org/rss", "research", "en"),
    (r"trends\.google\.com", "social-trends", "en"),
    (r"(spiegel|newsfeed\.zeit|tagesschau|\.faz\.|\.n-tv\.|freitag\.de|morgenpost|sueddeutsche|welt\.de|tagesspiegel|handelsblatt)", "germany", "de"),
    (r"(lemonde|lefigaro|liberation|france24\.com|rfi\.fr|mediapart|nouvelobs|francetvinfo|huffingtonpost\.fr|ladepeche|sudouest|ouest-france|20minutes\.fr|parisstaronline)", "france", "fr"),
    (r"(elpais|elmundo|elconfidencial|eldiario|e00-expansion|elperiodico\.com|euroweeklynews)", "spain", "es"),
    (r"(corriere|repubblica|ansa\.it|ilfattoquotidiano|lastampa)", "italy", "it"),
    (r"(asahi|mainichi|nhk\.or|japantimes)\.(jp|co\.jp|com)", "japan", "ja"),
    (r"(globo\.com|folha\.uol|estadao\.com|brasilwire|riotimesonline|jornaldebrasilia|uol\.com\.br)", "brazil", "pt"),
    (r"(thedailystar\.net|bd24live|jagonews24|prothomalo)", "bangladesh", "bn"),
    (r"(hongkongfp|hongkongnews\.net)", "hong-kong", "en"),
    (r"(thejournal\.ie|breakingnews\.ie|irishmirror\.ie|feedburner.*irish|the42\.ie|irishcentral)", "ireland", "en"),
    (r"(smh\.com\.au|abc\.net\.au|theage\.com\.au|perthnow|canberratimes|brisbanetimes|michaelwest\.com\.au|businessnews\.com\.au|independentaustralia)", "australia", "en"),
    (r"(globalnews\.ca|nationalpost|ottawacitizen|theprovince|lapresse\.ca|torontosun|financialpost|business\.financialpost)", "canada", "en"),
    (r"(republika\.co\.id)", "indonesia", "id"),
    (r"(scmp\.com)", "asia", "en"),
    (r"(bbc\.co\.uk|bbci\.co\.uk|theguardian\.com|skynews|independent\.co\.uk|telegraph\.co\.uk|\.ft\.com|thetimes|dailymail|thesun\.co\.uk)", "world-news", "en"),
    (r"(cnn\.com|nytimes\.com|nypost\.com|nbcnews|foxnews|abcnews\.go|cbsnews|npr\.org|washingtonpost|wsj\.com|usatoday|apnews|aljazeera|reuters\.com)", "world-news", "en"),
    (r"(politico\.com|axios\.com|bloomberg\.com|huffpost\.com|vox\.com|time\.com|rawstory|seattletimes|247newsaroundtheworld|worldnewsera|newsblaze)", "world-news", "en"),
    (r"(dw\.com|euronews|euractiv|euobserver|politico\.eu|ecfr\.eu|opendemocracy|eurozine|europeelects|thelocal\.)", "europe", "en"),
    (r"(techcrunch|theverge|wired\.|arstechnica|engadget|hackaday|theregister|techworld|macworld|pcworld|howtogeek|lifehacker|makeuseof|readwrite|venturebeat|technologyreview|smashingmagazine)", "tech", "en"),
    (r"(openai\.com|anthropic\.com|deepmind|huggingface\.co|artificialintelligence-news|thegradient\.pub)", "ai", "en"),
    (r"(krebsonsecurity|schneier\.com|bleepingcomputer|threatpost|darkreading|thecipherbrief)", "cybersecurity", "en"),
    (r"(espn\.com|skysports|bbcsport|cbssports|sportingnews|talksport|operationsports)", "sports", "en"),
    (r"(nature\.com|science\.org|newscientist|scientificamerican|sciencedaily|statnews|carbonbrief)", "science", "en"),
    (r"(economist\.com|forbes\.com|cnbc\.com|marketwatch|businessinsider|fortune\.com|entrepreneur\.com|sbnonline|homebusinessmag|thenonprofittimes)", "business", "en"),
    (r"(gamespot|nintendolife|indiegames|polygon\.com|gameinformer|news\.xbox|vg247|mynintendonews|rockpapershotgun|pcgamesn|kotaku|pushsquare|videogamer|toucharcade|gameinformer)", "gaming", "en"),
    (r"(rollingstone|variety\.com|artnews|artnet|lithub|newyorker\.com|salon\.com|vice\.com)", "culture", "en"),
    (r"(space\.com|esa\.int)", "space", "en"),
    (r"(propublica|theintercept|bellingcat|warontherocks|rand\.org|foreignpolicy|globalissues|e-ir\.info|justworldnews|defence-blog|wan-ifra)", "analysis", "en"),
    (r"(coindesk|decrypt\.co|cointelegraph)", "crypto", "en"),
    (r"(seriouseats|bonappetit|eater\.com)", "food", "en"),
    (r"(insidehighered|adventurouskate|adventure-journal)", "lifestyle", "en"),
    (r"(thenation|dailysignal|msnbc|washingtonexaminer|politico\.com)", "politics", "en"),
    (r"(kulturlotse|ooh\.directory|eurozine|stratechery|beehiiv)", "culture", "en"),
)


def infer_category(url: Column, rules: tuple[tuple[str, str, str], ...] | list = CATEGORY_RULES, category: Column | None = None, language: Column | None = None) -> Column:
    """struct<category, language> of the first rule (pattern, category, language) that fits the address.

    Without a fit the given values hold, else general, en.
    """
    keep = lambda c, default: F.coalesce(c, F.lit(default)) if c is not None else F.lit(default)
    out = F.struct(keep(category, "general").alias("category"), keep(language, "en").alias("language"))
    for pattern, name, lang in reversed(list(rules)):
        out = F.when(F.lower(url).rlike(pattern), F.struct(F.lit(name).alias("category"), F.lit(lang).alias("language"))).otherwise(out)
    return out


def merge_feeds(entries: DataFrame, order: str = "at") -> DataFrame:
    """One feed a canonical address, the first one, named by the first that has a name; invalid addresses go."""
    keyed = entries.withColumn("key", urls.canonicalize(F.col("url"))).where("key is not null")
    rest = [c for c in entries.columns if c != "name"]
    named = F.nullif(F.col("name"), F.lit(""))
    merged = keyed.groupBy("key").agg(F.min_by(F.struct(*rest), order).alias("row"), F.min_by(named, F.when(named.isNotNull(), F.col(order))).alias("name"))
    return merged.select("key", "row.*", "name")


def new_feeds(found: DataFrame, existing: DataFrame) -> DataFrame:
    known = existing.select(urls.canonicalize(F.col("url")).alias("key")).where("key is not null")
    return merge_feeds(found).join(known, "key", "left_anti")


def category_histogram(feeds: DataFrame, n: int = 12) -> DataFrame:
    return feeds.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(n)


# Content types and first elements of feeds.
FEED_TYPE = r"(?i)application/(rss|atom|rdf)\+xml|application/xml|text/xml"
FEED_ELEMENT = r"(?i)<(rss|feed|rdf:rdf|channel)[\s>]"


def alive(content_type: Column, body: Column) -> Column:
    """Whether an answer is a feed, by its type or its first 4 KiB."""
    return F.coalesce(content_type, F.lit("")).rlike(FEED_TYPE) | F.substring(F.coalesce(body, F.lit("")), 1, 4096).rlike(FEED_ELEMENT)


def loadable(ok: Column, content_type: Column, allow_origin: Column, redirected: Column, origin: str) -> Column:
    """Whether a page of `origin` may load a picture: an image that any origin, or this one unredirected, may read."""
    allowed = (allow_origin == "*") | ((allow_origin == origin) & ~redirected)
    return F.coalesce(ok & content_type.startswith("image/") & allowed, F.lit(False))


def drop_unloadable(articles: DataFrame, probes: DataFrame, origin: str) -> DataFrame:
    """Articles whose pictures' verdicts are negative lose the picture only; of several verdicts of an address the worst counts."""
    fine = loadable(F.col("ok"), F.col("type"), F.col("allow"), F.col("redirected"), origin)
    verdict = probes.groupBy("image").agg(F.min(fine).alias("fine"))
    joined = articles.join(verdict, "image", "left")
    return joined.withColumn("image", F.when(F.col("fine"), F.col("image"))).drop("fine")


def write_feed_list(feeds: DataFrame, path: str, backups: str | None = None, stamp: str | None = None, most: int | None = None) -> int:
    """Write the list as one JSON array by category and address; an earlier list is copied to `backups`/`stamp` first.

    `most` keeps the first feeds of that order. Returns how many were written. Lists are small: thousands of feeds.
    """
    from pyspark.errors import AnalysisException

    spark = feeds.sparkSession
    ordered = feeds.orderBy("category", "url")
    ordered = ordered if most is None else ordered.limit(most)
    cells = F.array_sort(F.collect_list(F.struct(F.coalesce("category", F.lit("")).alias("__c"), F.col("url").alias("__u"), F.struct(*feeds.columns).alias("feed"))))
    text = ordered.agg(F.to_json(F.transform(cells, lambda c: c["feed"])).alias("value"), F.count("*").alias("n")).first()
    if backups is not None:
        try:
            before = spark.read.text(path, wholetext=True).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            before = []
        if before:
            spark.createDataFrame([(r.value.rstrip("\n"),) for r in before], "value string").coalesce(1).write.mode("overwrite").text(f"{backups}/{stamp}")
    spark.createDataFrame([(text.value,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return int(text.n)
