"""Schemas and named constants."""

from __future__ import annotations

# fixed values
RAW_EXTENSIONS = ("cr2", "cr3", "crw", "nef", "nrw", "arw", "srf", "sr2", "dng", "raf", "rw2", "orf", "pef", "srw", "raw", "mrw")
STANDARD_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "webp", "bmp")
DIALOG_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "webp", "bmp", "cr2", "cr3", "nef", "arw", "dng", "raf", "rw2", "orf", "pef", "srw")
FACE_PROBE_EXTENSIONS = ("jpg", "jpeg", "png")
BLUR_THRESHOLD = 100.0
BLUR_LONG_EDGE = 400
DUPLICATE_DISTANCE = 12
BURST_GAP_SECONDS = 2
LEFT_EYE = (33, 160, 158, 133, 153, 144)
RIGHT_EYE = (362, 385, 387, 263, 373, 380)
EYE_THRESHOLD = 0.22
DETECTOR_INPUT = 640
SCORE_THRESHOLD = 0.6
OVERLAP_THRESHOLD = 0.3
BLUR_BOX_MARGIN = 0.1
CROP_MARGIN = 0.25
STRAIGHTEN_DEGREES = 10.0
EXPOSURE_TARGET = 0.5
POISSON_SWEEPS = 180
THUMBNAIL, PREVIEW, REVIEW = 320, 900, 1400
QUALITY_REVIEW, QUALITY_EXPORT = 88, 92

IMAGE_EXTENSIONS = STANDARD_EXTENSIONS + RAW_EXTENSIONS
#: Sliders whose absolute value below 0.01 means "no edit"; crop and geometry besides.
SLIDERS = (
    "auto_exposure", "auto_white_balance", "auto_contrast", "exposure", "contrast", "highlights", "shadows", "whites", "blacks",
    "saturation", "vibrance", "temperature", "tint", "sharpening", "straighten", "noise_reduction", "clarity", "vignette_amount",
    "vignette_midpoint", "shadow_hue", "shadow_sat", "highlight_hue", "highlight_sat",
)
CROP = ("crop_x", "crop_y", "crop_w", "crop_h")
PARAMS = "struct<" + ",".join(f"{n}:float" for n in SLIDERS + CROP) + ">"
PIXELS = "image_id long, y int, x int, r int, g int, b int"
PACKED = "image_id long, width int, height int, data binary"
