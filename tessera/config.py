"""Settings passed to the operators: one frozen dataclass, no environment files."""

from __future__ import annotations

from dataclasses import dataclass


# Fixed values that results depend on (defaults of the original pipeline).
BASE_SIMILARITY_THRESHOLD = 0.65
MIN_CHUNK_CHARS = 100
MAX_CHUNK_CHARS = 2000
THRESHOLD_STD_FACTOR = 0.1
THRESHOLD_CLAMP = (0.3, 0.9)
N_CLUSTERS = 5
N_INIT = 10
KMEANS_SEED = 42
SEARCH_K = 5
SEARCH_THRESHOLD = 0.7
ANSWER_THRESHOLD = 0.0
MEMORY_WINDOW = 20
MEMORY_TOP_N = 2
MEMORY_MIN_SIMILARITY = 0.5
MEMORY_ALPHA = 0.5
GRADE_MAX_ITEMS = 8
GRADE_TEXT_CHARS = 600
GRADE_THRESHOLD = 0.6
MAX_RETRIEVAL_ROUNDS = 1
NUM_REWRITES = 2
MAX_EVIDENCE_CHARS = 2000
CHAT_HISTORY = 8
NORM_EPS = 1e-12


@dataclass(frozen=True)
class Settings:
    base_threshold: float = BASE_SIMILARITY_THRESHOLD
    min_chunk_chars: int = MIN_CHUNK_CHARS
    max_chunk_chars: int = MAX_CHUNK_CHARS
    embedding_model: str = "hashed-trigram-64"
    embedding_dim: int = 64
    chunk_size: int = 512
    chunk_overlap: int = 64
    n_clusters: int = N_CLUSTERS
    n_init: int = N_INIT
    seed: int = KMEANS_SEED
    kmeans_iters: int = 20
    kmeans_local_rows: int = 20_000  # tasks up to this size cluster in one bounded group
    k: int = SEARCH_K
    search_threshold: float = SEARCH_THRESHOLD
    answer_threshold: float = ANSWER_THRESHOLD
    memory_window: int = MEMORY_WINDOW
    memory_top_n: int = MEMORY_TOP_N
    memory_min_similarity: float = MEMORY_MIN_SIMILARITY
    memory_alpha: float = MEMORY_ALPHA
    grade_max_items: int = GRADE_MAX_ITEMS
    grade_threshold: float = GRADE_THRESHOLD
    max_rounds: int = MAX_RETRIEVAL_ROUNDS
    num_rewrites: int = NUM_REWRITES
    max_evidence_chars: int = MAX_EVIDENCE_CHARS
    index_type: str = "exact-inner-product"
    # Scale knobs: rows of the query side that may be shipped to every executor,
    # and target vectors per cell of the salted grid when they may not.
    broadcast_max_queries: int = 50_000
    broadcast_max_bytes: int = 64 << 20
    vectors_per_cell: int = 200_000
