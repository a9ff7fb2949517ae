"""Vocabularies and thresholds of the engine; every rule takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the data model.
STAGES = ("概念宣传", "试点探索", "已上线", "规模化应用")
CONFIDENCE = ("官方确认·多源印证", "官方一手", "多源已验证", "深度单源", "单源待确认")
STATUS = ("新增", "延续", "静默", "旧闻/背景")
STICKY_REVIEW = ("watching", "confirmed", "rejected", "suspect_duplicate")
CLAIM_KINDS = ("fact", "inference", "recommendation")
RELATIONS = ("same_actor_track", "follows", "causes", "corroborates", "contradicts")
TRUSTED_TIME = ("exact", "parsed")
CHANNELS = ("rss", "rsshub", "direct", "jina", "aihot", "exa")

# Query parameters that only track visitors.
TRACKING_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "from", "spm", "share_token", "share_from", "scene", "srcid", "chksm",
    "sharer_shareinfo", "sharer_sharetime", "ref", "referrer", "_hsenc",
)

# Hosts whose accounts are organisations of their own, and two-part public suffixes.
SOCIAL_HOSTS = ("x.com", "twitter.com", "weibo.com", "weibo.cn", "linkedin.com", "t.me", "youtube.com", "bilibili.com")
TWO_PART_SUFFIXES = (
    "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn",
    "com.hk", "com.tw", "com.sg", "com.au", "co.uk", "co.jp", "co.kr",
)


@dataclass(frozen=True)
class EngineConfig:
    """One data set's settings."""

    ai_terms: tuple[str, ...] = ()
    industry_terms: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    company_aliases: dict[str, str] = field(default_factory=dict)
    collect_window_days: int = 30
    window_days: int = 30
    report_window_days: int = 7
    min_independent_orgs: int = 2
    hamming_threshold: int = 3
    unknown_source_class: str = "D"
    content_max_chars: int = 1200
    semantic_floor: float = 0.90
    semantic_top: int = 3
    semantic_days: int = 14
    semantic_pool: int = 400
    merge_floor: float = 0.80
    relate_low: float = 0.62
    relate_high: float = 0.80
    relate_top: int = 5
    relate_focus: int = 12
    title_jaccard: float = 0.34
