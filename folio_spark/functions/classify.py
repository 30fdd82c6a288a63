"""The page classifier: signals to route, actions, flags and reasons, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = ("requires_ocr", "low_confidence_text", "broken_encoding", "layout_uncertain", "table_uncertain", "unsupported_feature")
ROUTES = ("native_fast_path", "needs_fallback", "ocr_fallback", "unsupported")
#: Signals a page may lack, with the value that stands for them.
DEFAULTS = {"image_area_ratio": 0.0, "broken_encoding_ratio": 0.0, "bbox_overlap_ratio": 0.0, "duplicate_char_ratio": 0.0, "rotation_degrees": 0, "table_line_density": 0.0, "annotation_count": 0, "form_field_count": 0, "huge_object_count": 0, "span_geometry_capped": False}


def _picked(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]))


def with_route(pages: DataFrame) -> DataFrame:
    """pages with run_ocr, run_heavy_layout, run_table_recovery, flags, reasons and route."""
    p = pages.withColumns({k: F.lit(v) for k, v in DEFAULTS.items() if k not in pages.columns})
    c = F.col
    has = (c("native_span_count") > 0) & (c("native_text_bytes") > 0)
    sparse = has & (c("native_text_bytes") < 128)
    image = c("image_area_ratio")
    scan = (~has | sparse) & (image >= 0.70)
    overlay = has & ~sparse & (image >= 0.90)
    broken = c("broken_encoding_ratio") >= 0.20
    covered = broken & (image >= 0.70)
    overlap, double = c("bbox_overlap_ratio") >= 0.25, c("duplicate_char_ratio") >= 0.18
    turned = F.pmod(c("rotation_degrees"), F.lit(360)) != 0
    table = c("table_line_density") >= 0.25
    form = (c("annotation_count") > 0) | (c("form_field_count") > 0)
    huge, capped = c("huge_object_count") > 0, c("span_geometry_capped")
    flags = _picked(
        (scan, "requires_ocr"), (scan, "low_confidence_text"), (overlay, "layout_uncertain"), (broken, "broken_encoding"), (broken, "low_confidence_text"),
        (covered, "requires_ocr"), (overlap | double | turned, "layout_uncertain"), (table, "table_uncertain"), (form | huge | capped, "unsupported_feature"),
    )
    reasons = _picked(
        (scan & sparse, "high_image_coverage_with_sparse_native_text"), (scan & ~sparse, "high_image_coverage_without_native_text"), (overlay, "image_text_overlay"),
        (broken, "broken_encoding"), (covered & ~scan, "broken_encoding_with_image_coverage"), (overlap, "bbox_overlap"), (double, "duplicate_char_ratio"), (turned, "rotated_page"),
        (table, "table_line_density"), (form, "annotation_or_form"), (huge, "huge_object_count"), (capped, "span_geometry_capped"),
    )
    p = p.withColumns({"run_ocr": scan | covered, "run_heavy_layout": overlay | broken | overlap | double | turned, "run_table_recovery": table, "flags": F.array_distinct(flags), "reasons": reasons})
    route = F.when(F.size("flags") == 0, "native_fast_path").when(F.array_contains("flags", "unsupported_feature"), "unsupported").when(c("run_ocr"), "ocr_fallback").otherwise("needs_fallback")
    return p.withColumn("route", route)


def with_quality(pages: DataFrame) -> DataFrame:
    """pages with text_confidence and layout_confidence from their flags."""
    low = F.array_contains("flags", "low_confidence_text")
    unsure = F.array_contains("flags", "layout_uncertain") | F.array_contains("flags", "table_uncertain")
    return pages.withColumns({"text_confidence": F.when(low, 25).otherwise(90), "layout_confidence": F.when(unsure, 40).otherwise(85)})


def margin_role(y0: Column, y1: Column, height: Column, kind: Column) -> Column:
    """header or footer for a block wholly in the top or bottom 12 % of a page and no table, else null."""
    edge = height * 0.12
    open_ = (height > 0) & (kind != "table")
    return F.when(open_ & (y1 <= edge), "header").when(open_ & (y0 >= height - edge), "footer")


def claim_status(ran: Column, comparable: Column, speedup: Column, least: Column, checked: Column, quality: Column) -> Column:
    """The state of a speed claim, first blocker first."""
    return (
        F.when(~ran, "baseline_not_run").when(~comparable, "not_speed_comparable").when(speedup < least, "speedup_failed").when(~checked, "quality_not_checked").when(~quality, "quality_failed").otherwise("passed")
    )
