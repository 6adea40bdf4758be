"""Configuration files of the offline search: white-space separated values in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class BlockIndex:
    offset: int
    key_bits: int
    index_path: str
    sample_path: str


@dataclass(frozen=True)
class SearchConfig:
    """Sample rate, base folder, index description, then four values per block order."""
    sample_rate: int
    base: str
    description: str
    blocks: tuple[BlockIndex, ...]


def parse_search_config(text: str) -> SearchConfig:
    rate, base, description, *rest = text.split()
    if len(rest) % 4:
        raise ValueError("a block order has four values: offset, key bits, index path, sample path")
    blocks = (BlockIndex(int(o), int(k), i, s) for o, k, i, s in zip(*[iter(rest)] * 4))
    return SearchConfig(int(rate), base, description, tuple(blocks))


def read_search_config(spark: SparkSession, path: str) -> SearchConfig:
    return parse_search_config("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


@dataclass(frozen=True)
class ServerConfig:
    """A port of one's own, then the hosts and ports of the servers that work is dealt to."""
    port: int
    servers: tuple[tuple[str, int], ...]


def parse_server_config(text: str) -> ServerConfig:
    port, *rest = text.split()
    return ServerConfig(int(port), tuple((host, int(p)) for host, p in zip(rest[::2], rest[1::2])))


def read_server_config(spark: SparkSession, path: str) -> ServerConfig:
    return parse_server_config("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
