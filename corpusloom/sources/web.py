"""Captures as a Spark data source: one input partition per host, so a host is only ever read in turn, at its pace.

    spark.dataSource.register(WebSource)
    spark.read.format("captures").option("urls", json.dumps([...])).option("agent", "name (contact)").load()

Options: urls (JSON list), agent (how the reader names itself), pace (seconds between reads of a host), timeout, robots
("obey", or "none" for a server of one's own), holds (JSON list of hosts to leave alone). Each row tells what came of a url:
status, headers and body, or why there is none. Bodies beyond ``MOST_BYTES`` are cut; gzip is undone by its magic.
"""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.request
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_BYTES, PAUSE_AFTER_DROP = 25_000_000, 3.0
SCHEMA = "url string, final_url string, status int, content_type string, headers map<string,string>, body binary, error string, fetched_at double"


class HostUrls(InputPartition):
    def __init__(self, host: str, urls: list[str]) -> None:
        super().__init__(host)
        self.host, self.urls = host, urls


class WebReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        self.agent, self.pace, self.timeout = options.get("agent", "captures"), float(options.get("pace", "1")), float(options.get("timeout", "20"))
        self.obey, self.holds = options.get("robots", "obey") == "obey", set(json.loads(options.get("holds", "[]")))

    def partitions(self) -> list[HostUrls]:
        by: dict[str, list[str]] = {}
        for u in dict.fromkeys(self.urls):
            by.setdefault(urlsplit(u).netloc.lower(), []).append(u)
        return [HostUrls(h, us) for h, us in sorted(by.items())] or [HostUrls("", [])]

    def _get(self, url: str):
        return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept-Encoding": "gzip"}), timeout=self.timeout)  # noqa: S310

    def _rules(self, url: str) -> RobotFileParser:
        """No rules for a 4xx or no answer, everything forbidden for a 5xx."""
        rules, p = RobotFileParser(), urlsplit(url)
        lines: list[str] = []
        try:
            with self._get(f"{p.scheme}://{p.netloc}/robots.txt") as r:
                lines = r.read(500_000).decode("utf-8", "replace").splitlines()
        except urllib.error.HTTPError as e:
            lines = ["User-agent: *", "Disallow: /"] if e.code >= 500 else []
        except OSError:
            lines = []
        rules.parse(lines)
        return rules

    def _read(self, url: str) -> tuple:
        try:
            with self._get(url) as r:
                body = r.read(MOST_BYTES)
                body = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
                return url, r.geturl(), r.status, r.headers.get("Content-Type", ""), dict(r.headers.items()), body, None, time.time()
        except urllib.error.HTTPError as e:
            return url, e.geturl() or url, e.code, e.headers.get("Content-Type", ""), dict(e.headers.items()), e.read(MOST_BYTES), None, time.time()
        except Exception as e:  # noqa: BLE001 - what failed is a value of the row
            return url, url, None, None, None, None, f"{type(e).__name__} {e}", time.time()

    def read(self, partition: HostUrls):
        if partition.host in self.holds:
            for u in partition.urls:
                yield u, u, None, None, None, None, "held", time.time()
            return
        rules = self._rules(partition.urls[0]) if self.obey and partition.urls else None
        gap = max(self.pace, min(float((rules and rules.crawl_delay(self.agent)) or 0), 30.0))
        for i, u in enumerate(partition.urls):
            if rules and not rules.can_fetch(self.agent, u):
                yield u, u, None, None, None, None, "robots_disallowed", time.time()
                continue
            if i:
                time.sleep(gap)
            row = self._read(u)
            if row[6] and ("Disconnected" in row[6] or "ConnectionReset" in row[6]):  # once more, for a dropped connection only
                time.sleep(PAUSE_AFTER_DROP)
                row = self._read(u)
            yield row


class WebSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WebReader:
        return WebReader(dict(self.options))
