"""Every default of the engine that changes results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # One day's stories
    max_articles: int = 40_000
    min_topic_size: int = 3
    min_sources: int = 3
    headline_similarity: float = 0.30
    merge_similarity: float = 0.50
    candidate_df_share: float = 0.01
    candidate_df_floor: int = 50
    label_words: int = 8
    sample_headlines: int = 10
    centroid_terms: int = 60
    stored_topics: int = 200
    theme_similarity: float = 0.30
    # History and follow-ups
    history_days: int = 14
    history_similarity: float = 0.40
    follow_up_days: int = 2
    follow_up_rank: int = 20
    follow_up_share: float = 0.6
    follow_up_df_share: float = 0.005
    follow_up_lift: float = 5.0
    follow_up_per_feed: int = 3
    follow_up_baseline_days: int = 7
    # Videos
    video_similarity: float = 0.30
    video_shared_words: int = 2
    videos_per_topic: int = 3
    # Briefing
    articles_per_topic: int = 5
    max_topics: int = 15
    min_topics: int = 5
    score_floor: float = 0.4
    candidate_pool: int = 40
    per_section: int = 5
    soft_minimum_score: float = 0.5
    description_chars: int = 300
    topic_article_pool: int = 200
    specialist_share: float = 0.3
    # Ingest
    feed_interval_minutes: int = 10
    max_items: int = 50
    max_backoff_minutes: int = 24 * 60
    future_hours: int = 24


DEFAULTS = Settings()
SECTIONS = ("world", "politics", "business", "technology", "science-health", "sports", "culture")
SOFT_MINIMUM_SECTIONS = ("technology", "business", "science-health", "sports", "culture")
NEWS, VIDEO, RESEARCH = 1, 2, 3
