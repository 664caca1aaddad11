"""Paginated REST ingest as a Spark data source with a pluggable transport.

``transport`` names a factory ``module:function`` that takes the options and returns a callable
``(url, params) -> (status, headers, payload)``; tests replay recorded pages with it.  The payload
is the decoded JSON of an API page and the bytes of any other file.  Pages of
a court follow each other by their ``next`` link, so a court is one partition and courts are
read in parallel.
"""

from __future__ import annotations

import importlib
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .html import text_of, text_of_pdf

# The service's retry rules and page size.
RETRIED = {429, 500, 502, 503, 504}
ATTEMPTS, DELAY, BACKOFF, JITTER, LONGEST = 10, 0.8, 1.7, 0.6, 30.0
PAGE_SIZE = 100
SCHEMA = "circuit string, _cid string, name string, docket_number string, decision_date string, opinion_text string"

Transport = Callable[[str, dict | None], tuple[int, dict, object]]


def urllib_transport(options: dict[str, str]) -> Transport:
    def get(url, params):
        if params:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
        headers = {"User-Agent": options.get("useragent", "lexloom")}
        # Downloads lie on other hosts, which must not see the token; nor may a host that a request is redirected to.
        own = not options.get("base") or urllib.parse.urlsplit(url).netloc == urllib.parse.urlsplit(options["base"]).netloc
        request = urllib.request.Request(url, headers=headers)
        if own:
            request.add_unredirected_header("Authorization", f"Token {options.get('token', '')}")
        try:
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", 60))) as r:
                body = r.read()
                return r.status, dict(r.headers), json.loads(body) if r.headers.get_content_type().endswith("json") else body
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), None

    return get


class Refused(RuntimeError):
    """An HTTP error that another attempt would not mend."""


class Client:
    """GET with bounded retries; parameters are sent again on every attempt."""

    def __init__(self, transport: Transport, sleep: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS):
        self.transport, self.sleep, self.attempts = transport, sleep, attempts

    def get(self, url: str, params: dict | None = None):
        last: object = None
        for a in range(self.attempts):
            pause = min(DELAY * BACKOFF**a + random.uniform(0, JITTER), LONGEST)
            try:
                status, headers, payload = self.transport(url, params)
            except (TimeoutError, ConnectionError, urllib.error.URLError) as e:
                last = e
                self.sleep(pause)
                continue
            if status in RETRIED:
                last = status
                try:
                    self.sleep(float(headers.get("Retry-After", 0)))
                except ValueError:
                    pass
                self.sleep(pause)
                continue
            if status >= 400:
                raise Refused(f"{url}: HTTP {status}")
            return payload
        raise RuntimeError(f"{url}: gave up after {self.attempts} attempts ({last})")


def cluster_id(item: dict) -> str | None:
    if item.get("cluster_id"):
        return str(item["cluster_id"])
    link = str(item.get("cluster") or "")
    return link.rstrip("/").split("/")[-1] if "/clusters/" in link else None


def download_text(client: Client, url: str | None) -> str | None:
    """Text of the PDF file at ``url``; None if there is no link or it leads to no file."""
    if not url:
        return None
    try:
        return text_of_pdf(client.get(url))
    except Refused:
        return None


def cluster_text(client: Client, base: str, cid: str) -> str:
    """Opinion text: the cluster's own, else its first opinion's (plain, cited HTML, HTML, PDF), else the cluster's PDF."""
    cluster = client.get(f"{base}/clusters/{cid}/") or {}
    for field in ("plain_text", "plain_text_with_citations"):
        if cluster.get(field):
            return cluster[field]
    opinions = cluster.get("sub_opinions") or cluster.get("opinions") or []
    if opinions:
        first = opinions[0] if isinstance(opinions[0], str) else opinions[0].get("resource_uri") or opinions[0].get("id")
        opinion = client.get(first if isinstance(first, str) else f"{base}/opinions/{first}/") or {}
        if opinion.get("plain_text"):
            return opinion["plain_text"]
        for field in ("html_with_citations", "html"):
            if opinion.get(field):
                return text_of(opinion[field])
        text = download_text(client, opinion.get("download_url"))
        if text is not None:
            return text
    return download_text(client, cluster.get("download_url")) or ""


def docket_number(client: Client, base: str, cid: str, item: dict) -> str:
    """The search hit's docket, else the docket page's number, else its core number, else ''."""
    if item.get("docketNumber"):
        return item["docketNumber"]
    try:
        link = (client.get(f"{base}/clusters/{cid}/") or {}).get("docket")
        page = client.get(link) if link else {}
        return (page or {}).get("docket_number") or (page or {}).get("docket_number_core") or ""
    except RuntimeError:
        return ""


def ingest(spark, path: str, circuits: list[str], options: dict[str, str], every: int = 200, limit: int | None = None) -> int:
    """Append all opinions that ``path`` (parquet) does not have yet, at most ``every`` of a circuit at a time; returns their number.

    Stored ids are read first, and their texts are not asked for again, so a run that was stopped
    goes on where it was.  ``limit`` counts the stored opinions of a circuit too.
    """
    from .files import exists

    added = 0
    while True:
        have: dict[str, list[str]] = {c: [] for c in circuits}
        if exists(spark, path):
            for r in spark.read.schema(SCHEMA).parquet(path).select("circuit", "_cid").where("_cid is not null").distinct().toLocalIterator():
                have.setdefault(r.circuit, []).append(r["_cid"])
        fresh = None
        for c in circuits:
            most = min(len(have[c]) + every, limit if limit is not None else 1 << 60)
            one = spark.read.format("opinion_rest").options(**options, circuits=c, limit=str(most), seen=json.dumps({c: have[c]})).load()
            fresh = one if fresh is None else fresh.unionByName(one)
        got = Observation()
        fresh.observe(got, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
        added += got.get["n"]
        if not got.get["n"]:
            return added


class _Court(InputPartition):
    def __init__(self, circuit: str):
        self.circuit = circuit


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self):
        return [_Court(c.strip()) for c in self.options["circuits"].split(",")]

    def read(self, part: _Court) -> Iterator[tuple]:
        o = self.options
        module, _, name = o.get("transport", "lexloom.sources.rest:urllib_transport").partition(":")
        client = Client(getattr(importlib.import_module(module), name)(o))
        base, limit = o["base"].rstrip("/"), int(o["limit"]) if "limit" in o else None
        digits = "".join(ch for ch in part.circuit if ch.isdigit())
        if not digits:
            raise ValueError(f"not a numbered circuit: {part.circuit}")
        url, params = f"{base}/search/", {"court": f"ca{digits}", "type": "o", "page_size": PAGE_SIZE}
        seen = {str(c) for c in json.loads(o.get("seen", "{}")).get(part.circuit, [])}
        while url and (limit is None or len(seen) < limit):
            page = client.get(url, params)
            for item in page.get("results", []):
                if limit is not None and len(seen) >= limit:
                    break
                cid = cluster_id(item)
                if not cid or cid in seen:
                    continue
                text = cluster_text(client, base, cid)
                if not text:
                    continue
                seen.add(cid)
                yield part.circuit, cid, (item.get("caseName") or "").strip(), docket_number(client, base, cid, item), item.get("dateFiled") or "", text
            url, params = page.get("next"), None


class OpinionRestSource(DataSource):
    """``spark.read.format("opinion_rest").option("base", ...).option("circuits", "1st,3rd").load()``"""

    @classmethod
    def name(cls) -> str:
        return "opinion_rest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))
