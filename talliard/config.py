"""Configuration of an engine, with the defaults users of such ledgers expect."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from talliard.functions.routing import Strategy, strategy


@dataclass(frozen=True)
class LedgerConfig:
    base_dir: str = "./data/"
    engine_name: str = "ledger"
    partitions: int = 1
    batch_size: int = 1000
    queue_size: int = 65536
    snapshot_interval: int = 50_000
    time_snapshot: bool = True
    time_snapshot_interval: timedelta = timedelta(minutes=10)
    heartbeat: timedelta = timedelta(seconds=10)
    idempotency: str = "BLOOM"
    routing: str = "RENDEZVOUS"
    total_nodes: int = 1
    node_id: int = 0

    def __post_init__(self):
        if self.partitions < 1 or self.total_nodes < 1 or not 0 <= self.node_id < self.total_nodes:
            raise ValueError("partitions and total_nodes must be positive, node_id below total_nodes")

    def strategy(self) -> Strategy:
        return strategy(self.routing)

    def dedup_name(self) -> str:
        """LRU in any case is the bounded window; anything else the membership filter, which here is exact."""
        return "LRU" if self.idempotency.strip().upper() == "LRU" else "BLOOM"

    def files_per_trigger(self) -> int:
        """Files of the log that may be under way at once: as many as ``queue_size`` commands come in, at ``batch_size`` a file."""
        return max(1, self.queue_size // max(1, self.batch_size))

    def node_dir(self) -> str:
        return f"{self.base_dir.rstrip('/')}/{self.engine_name}/node-{self.node_id}"

    def partition_name(self, index: int) -> str:
        return f"{self.engine_name}-p{index}"

    def partition_dir(self, index: int) -> str:
        return f"{self.node_dir()}/{self.partition_name(index)}"
