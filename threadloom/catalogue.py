"""Vocabularies and constants that define results. All can be replaced by arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Brand:
    brand_id: str
    name: str
    display_name: str
    country: str
    segment: str
    keywords: tuple[str, ...]


# The brand dimension.
BRANDS = (
    Brand("brand_01", "VinFast", "VinFast Auto", "Vietnam", "EV",
          ("vinfast", "vfs", "vf3", "vf5", "vf6", "vf7", "vf8", "vf9")),
    Brand("brand_02", "Tesla", "Tesla, Inc.", "USA", "EV", ("tesla",)),
    Brand("brand_03", "BYD", "BYD Auto Co.", "China", "EV", ("byd",)),
    Brand("brand_04", "Toyota", "Toyota Motor", "Japan", "Hybrid", ("toyota",)),
    Brand("brand_05", "BMW", "BMW Group", "Germany", "Luxury", ("bmw",)),
    Brand("brand_06", "Mercedes", "Mercedes-Benz", "Germany", "Luxury", ("mercedes",)),
    Brand("brand_07", "Hyundai", "Hyundai Motor", "South Korea", "General", ("hyundai",)),
    Brand("brand_08", "Ford", "Ford Motor Co.", "USA", "General", ("ford",)),
    Brand("brand_09", "Porsche", "Porsche AG", "Germany", "Luxury", ("porsche",)),
    Brand("brand_10", "Volkswagen", "Volkswagen AG", "Germany", "General", ("volkswagen", "vw")),
)

# Resale phrases; a blank may be written as white space, "_" or nothing.
SALE_PHRASES = (
    "thanh lý", "sang nhượng", "chuyển nhượng", "nhượng lại", "tìm mua", "cần mua", "cần bán",
    "rao bán", "đăng bán", "giá bán", "giá xe", "xe cũ", "xe secondhand", "second hand",
    "liên hệ mua", "inbox mua", "pm giá",
)

# Profanity list of the report view; "|" marks a word edge.
PROFANITY = (
    "đcm", "dcm", "đkm", "dkm", "đm|", "|dm|", "clm", "vl|", "|cc|", "lồn", "lon", "cặc", "cac",
    "địt", "|dit|", "đéo", "|deo|", "mẹ kiếp", "đụ", "du má",
)


@dataclass(frozen=True)
class Vocabulary:
    """Allowed values of an insight item. ``aspects=None`` accepts any non-blank aspect."""

    entities: tuple[str, ...]
    aspects: tuple[str, ...] | None
    aliases: tuple[tuple[str, str], ...] = ()
    entity_field: str = "entity"
    fold_case: bool = False


# Insight vocabularies.
GROUP_VOCABULARY = Vocabulary(
    entities=("VF3", "VF5", "VF6", "VF7", "VF8", "VF9", "general"),
    aspects=("pin", "sac", "bao_hanh", "phan_mem", "van_hanh", "gia", "loi_ky_thuat", "noi_that", "ket_noi"),
    entity_field="model_entity",
)
VIDEO_VOCABULARY = Vocabulary(
    entities=("iphone", "ios", "android"), aspects=None, aliases=(("ios", "iphone"),), fold_case=True,
)
SENTIMENTS = ("positive", "negative", "neutral", "mixed")
INTENSITIES = ("strong", "moderate", "mild")
VIDEO_BRANDS = (("iPhone", ("iphone", "ios")), ("Android", ("android",)))


@dataclass(frozen=True)
class Lexicon:
    """Words that decide a label when no trained model is plugged in."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    whole_words: bool = True


SENTIMENT_LEXICON = Lexicon(
    positive=("good", "great", "love", "best", "amazing", "excellent", "tốt", "đẹp", "thích"),
    negative=("bad", "hate", "worst", "boring", "limited", "terrible", "tệ", "lỗi", "chán"),
)
STANCE_LEXICON = Lexicon(
    positive=("agree", "exactly", "right", "true", "yes", "đúng", "chuẩn"),
    negative=("disagree", "wrong", "false", "no", "nonsense", "sai"),
)
