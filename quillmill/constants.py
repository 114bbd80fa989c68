"""Fixed values that results depend on. They are decisions of the ranking, not settings."""

BM25_K1 = 1.2
BM25_B = 0.75
METADATA_WEIGHT = 0.6
RRF_K = 60
FUSION_DEPTH = 20
SPAN_LINES = 40
RESULTS = 5
FILE_BUDGET = 50_000
NAME_ATTEMPTS = 100
SLUG_LENGTH = 48
DIGEST_LENGTH = 12
MESSAGE_LENGTH = 80
MANIFEST_VERSION = 1

# fixed values: English and Spanish words without retrieval signal, compared after folding
STOP_WORDS = tuple(
    (
        "a an the and or but if then of to in on for with without at by from as is are was were be been being "
        "it its this that these those i you he she they we my your our not no do does did can could should would will just "
        "de la el los las un una y o pero si en con por para del al que se es son ser lo su sus como mas"
    ).split()
)

# fixed values: hosts and paths of the video rule
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com")
VIDEO_SHORT_HOSTS = ("youtu.be", "www.youtu.be")
VIDEO_PREFIXES = ("shorts", "embed", "live", "v")
VIDEO_CANONICAL = "https://www.youtube.com/watch?v="

# fixed values: recognised frontmatter fields
SCALAR_FIELDS = ("id", "type", "kind", "url", "created", "updated")
LIST_FIELDS = ("tags", "aliases", "derived_from", "about")
