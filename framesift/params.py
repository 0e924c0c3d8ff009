"""Defaults and tables results depend on."""

# Selection.
EVERY_NTH = 15
MOTION_THRESHOLD = 0.04
MOTION_WINDOW = 8
METRIC_WIDTH = 480

# Sky heuristic.
SKY_LUMA_MIN = 130
SKY_BLUE_BIAS = -8
SKY_GRADIENT_MAX = 14
SKY_DILATE = 3

# Segmentation.
SEG_WIDTH = 640
SEG_STRIDE = 32
SEG_WINDOW = 1
SEG_MAX_CLASSES = 256
SEG_CLASSES_WITH_BACKGROUND = 151
SKY_CLASS_ID = 2
PERSON_CLASS_ID = 12
SEG_SKY_DILATE = 3
SEG_PEOPLE_DILATE = 12
NORM_MEAN = (0.485, 0.456, 0.406)
NORM_STD = (0.229, 0.224, 0.225)

# Output.
MAX_SCALE = 8.0
JPEG_QUALITY = 95
INTERPOLATION = "bilinear"

# Mask classes, the sidecar sets each one is written to, and their folders.
MASK_ROUTING = {
    "sky": ("sfm",),
    "people": ("sfm", "training"),
}
SIDECAR_DIRS = {
    "sfm": "masks",
    "training": "masks_train",
}

# Audits.
GAP_MIN_SECONDS = 4.0
GAP_VS_USUAL = 4.0
ASPECT_TOLERANCE = 0.02
FPS_TOLERANCE = 1.0
FPS_REFUSED = 1000.0
SEARCH_LIMIT = 100

# Containers a folder scan accepts.
VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "avi", "mts", "m2ts", "webm")

# Luma weights, in 256ths.
LUMA_RED = 77
LUMA_GREEN = 150
LUMA_BLUE = 29

# Registration check.
REG_SPURIOUS_PX = 5.0
REG_LOW_TEXTURE_STD = 3.0

# Rows of one clip that one task handles in order.  A clip longer than this is
# split, so no task or sort ever holds a whole clip.
SEGMENT_FRAMES = 4096
# Frames replayed before a segment to guess the state it starts from.
WARMUP_FRAMES = 64
# Frame numbers per row of a stored kept list.
KEPT_CHUNK = 65536
