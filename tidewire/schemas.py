"""Schemas of the stored relations and of the documents that are read and served."""

ARTICLES = (
    "url_hash decimal(20,0), url string, feed_url string, feed_title string, title string, summary string, image_url string, "
    "author string, published_at timestamp, fetched_at timestamp, source_type short, tags array<string>"
)
TOPICS = (
    "id string, topic_date date, status string, label_keywords array<string>, entities array<string>, centroid_vector map<string,double>, "
    "article_count long, unique_source_count long, novelty_score double, burst_score double, burst_z_score double, source_diversity double, "
    "persistence_score double, entity_importance double, final_score double, max_historical_similarity double, active_windows array<string>, "
    "matched_historical_topic_ids array<string>, sample_headlines array<string>, top_sources array<string>, theme_id string, theme_label array<string>, rank int"
)
SCORED = (
    "day date, id string, cluster long, article_count long, unique_source_count long, article_hashes array<string>, entities array<string>, sample_headlines array<string>, "
    "top_sources array<string>, active_windows array<string>, label_keywords array<string>, centroid_vector map<string,double>, headline string, theme_id string, "
    "theme_label array<string>, max_historical_similarity double, matched_historical_topic_ids array<string>, novelty_score double, burst_z_score double, burst_score double, "
    "source_diversity double, persistence_score double, entity_importance double, final_score double, status string, rank int, video_hashes array<string>"
)
TOPIC_ARTICLES = "topic_id string, url_hash decimal(20,0), topic_date date"
FEED_ENTRY = "url string, enabled boolean, intervalMinutes double, maxItems double, sourceType string, category string, language string, source string, name string"
POLL_STATE = "feed_url string, last_success timestamp, last_failure timestamp, failure_count int, next_poll timestamp"
STORY = (
    "id string, title string, headline string, summary string, label array<string>, category string, section string, theme string, entities array<string>, "
    "article_count long, source_count long, articles array<struct<title:string,url:string,source:string,published_at:string,image:string,description:string>>, "
    "videos array<struct<title:string,url:string,video_id:string,channel:string,published_at:string,thumbnail:string>>"
)
BRIEFING = f"date string, generated_at string, overview struct<points:array<struct<text:string,stories:array<int>>>>, topics array<struct<{', '.join(p.replace(' ', ':', 1) for p in STORY.split(', '))}>>"
