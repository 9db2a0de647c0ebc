"""Annotation labels: mapping, list mapping and annotator agreement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names of the annotation study and their short forms.
TYPES = {
    "Individual": "individual",
    "Individual:Male": "individual_male",
    "Institution": "institution",
    "Individual: Other gender or unclear": "individual_unclear",
    "Unclear": "unclear",
    "Individual:Female": "individual_female",
}
TYPES_MERGED = {
    "Individual": "individual",
    "Individual:Male": "individual",
    "Institution": "institution",
    "Individual: Other gender or unclear": "individual",
    "Unclear": "unclear",
    "Individual:Female": "individual",
}
CATEGORIES = {
    "Media": "media",
    "Other": "other",
    "Media: News": "media_news",
    "Media: Other Media": "media_other",
    "Government and Politics": "politics",
    "Outspoken Political Supporter": "political_supporter",
    "Media: Scientific News and Communication": "media_scientific",
    "Art": "art",
    "Business": "business",
    "Non-Governmental Organization": "ngo",
    "Healthcare": "healthcare",
    "Science: Social Sciences": "science_social",
    "Public Services": "public_services",
    "Science: Engineering and Technology": "science_engineering",
    "Sport": "sports",
    "Science: Other Science": "science_other",
    "Religion": "religion",
    "Science: Life Sciences": "science_lifescience",
    "Porn": "porn",
    "Not in English": "non_english",
}
CATEGORIES_MERGED = {
    "Media": "media",
    "Other": "other",
    "Government and Politics": "politics",
    "Outspoken Political Supporter": "political_supporter",
    "Art": "art",
    "Business": "business",
    "Non-Governmental Organization": "ngo",
    "Healthcare": "healthcare",
    "Public Services": "public_services",
    "Science": "science",
    "Sport": "sports",
    "Religion": "religion",
    "Porn": "porn",
    "Not in English": "non_english",
}
GENDERS = {
    "Individual:Female": "female",
    "Individual:Male": "male",
    "Individual: Other gender or unclear": "other",
}


def _lookup(c: Column, mapping: dict[str, str], strict: bool) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.element_at(table, c)
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("unknown label: "), c)).cast("string"))
    return F.when(c.isNotNull() & (c != ""), found)


def map_label(c: Column, mapping: dict[str, str], strict: bool = True) -> Column:
    """Short form of a label; '' and NULL give NULL, an unknown label fails the job unless not `strict`."""
    return _lookup(c, mapping, strict)


def map_labels(c: Column, mapping: dict[str, str], strict: bool = True) -> Column:
    """Distinct short forms of a label list, sorted; '' and NULL elements become one NULL element."""
    return F.array_sort(F.array_distinct(F.transform(c, lambda x: _lookup(x, mapping, strict))))


def _disagree(annotations: Column, at_least: int) -> Column:
    return (F.size(annotations) < at_least) | (F.size(F.array_distinct(annotations)) != 1)


def is_ambiguous(*annotations: Column, at_least: int = 3) -> Column:
    """Fewer than three answers, or more than one distinct answer."""
    return _disagree(F.filter(F.array(*annotations), lambda x: x.isNotNull()), at_least)


def is_ambiguous_multi(*annotations: Column, at_least: int = 3) -> Column:
    """As `is_ambiguous` over label lists: only lists with exactly one element count, and it may be NULL."""
    single = F.filter(F.array(*annotations), lambda x: F.coalesce(F.size(x) == 1, F.lit(False)))
    return _disagree(F.transform(single, lambda x: F.get(x, F.lit(0))), at_least)
