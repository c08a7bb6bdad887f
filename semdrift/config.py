"""Settings of the detector. The defaults are fixed values that results depend on."""

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorConfig:
    # Share of a route's observed time range that counts as settled history.
    baseline_fraction: float = 0.5
    # A route is flagged beyond mean + sigma * population stddev.
    sigma: float = 2.0
    # Ceiling for the number of normal clusters per route.
    n_clusters: int = 4
    # Routes with fewer samples keep their old baseline.
    min_samples: int = 30
    # Samples wanted per cluster when choosing the number of clusters.
    samples_per_cluster: int = 30
    # Cosine similarity from which a turn repeats remembered drift.
    memory_threshold: float = 0.9
    # Floor added to each variance.
    epsilon: float = 1e-6
    # Lloyd rounds; the loop ends earlier once no centroid moves.
    lloyd_rounds: int = 20
    # Keep the baseline sample cached between Lloyd rounds.
    cache_sample: bool = True
    # Cluster tables up to this size are shipped to the executors whole.
    # Beyond it they are joined by route.
    cluster_book_bytes: int = 256 * 1024 * 1024
    # The same for remembered vectors; beyond it they are searched in blocks.
    memory_book_bytes: int = 128 * 1024 * 1024
