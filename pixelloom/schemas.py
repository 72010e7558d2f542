"""Table layouts."""

from pyspark.sql import types as T

# fixed values: manifest columns and their order on disk
MANIFEST_COLUMNS = [
    "session", "animal", "processed_path", "image_path", "roi_path", "height", "width",
    "roi_count", "positive_pixels", "positive_fraction", "median_roi_area_px",
    "min_roi_area_px", "max_roi_area_px", "invalid_roi_entries", "included",
    "exclusion_reason", "split",
]
MANIFEST_KINDS = {
    "height": "int", "width": "int", "roi_count": "bigint", "positive_pixels": "bigint",
    "positive_fraction": "double", "median_roi_area_px": "double", "min_roi_area_px": "bigint",
    "max_roi_area_px": "bigint", "invalid_roi_entries": "bigint", "included": "boolean",
}
MANIFEST_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in MANIFEST_COLUMNS])
