"""Reading live or recorded search answers inside a Python data source: rate limits, retries, paging, isolation.

``SearchSource`` is a Spark data source whose partitions are pages (or one partition per source where the next page is
only known from the last).  The transport is a function from (source, request) to (status, body), so tests and offline
runs use recorded answers.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Requests a second by source (without a key, with one).
RATES = {"openalex": (10, 10), "crossref": (15, 15), "semantic_scholar": (1, 10), "arxiv": (3, 3), "pubmed": (3, 10), "ieee": (1, 1), "doaj": (5, 5)}
PAGE_SIZES = {"openalex": 200, "crossref": 100, "semantic_scholar": 1000, "arxiv": 100, "pubmed": 200, "ieee": 200, "doaj": 100}
#: Records of a PubMed search are fetched so many at a time.
FETCH_BATCH = 200

Transport = Callable[[str, dict], tuple[int, str]]


class SourceUnavailable(Exception):
    pass


class TokenBucket:
    """Starts full; refills with time up to its capacity."""

    def __init__(self, rate: float, capacity: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.capacity, self.clock, self.sleep = rate, capacity or rate, clock, sleep
        self.tokens, self.at = float(self.capacity), clock()

    def try_consume(self) -> bool:
        now = self.clock()
        self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rate), now
        if self.tokens >= 1 - 1e-9:
            self.tokens -= 1
            return True
        return False

    def wait(self) -> None:
        while not self.try_consume():
            self.sleep(max((1 - self.tokens) / self.rate, 0.001))


def with_retries(call: Callable[[], tuple[int, str]], tries: int = 4, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> str:
    """429, 5xx and lost connections are tried again after 1, 2, 4 ... s plus jitter; other errors end at once."""
    for attempt in range(tries):
        try:
            status, body = call()
        except ConnectionError:
            status, body = 599, ""
        if status < 400:
            return body
        if status != 429 and status < 500:
            raise SourceUnavailable(f"status {status}")
        if attempt + 1 < tries:
            sleep(2**attempt + jitter())
    raise SourceUnavailable(f"status {status} after {tries} tries")


@dataclass(frozen=True)
class SearchQuery:
    term: str
    year_from: int | None = None
    year_to: int | None = None
    language: str | None = None
    max_results: int = 100
    offset: int = 0
    with_raw: bool = False
    project: str = ""
    metadata: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if len(self.term.strip()) < 2:
            raise ValueError("a search term has two characters at least")
        this_year = time.gmtime().tm_year
        for y in (self.year_from, self.year_to):
            if y is not None and not 1000 <= y <= this_year + 5:
                raise ValueError(f"year {y} is out of range")
        if self.year_from is not None and self.year_to is not None and self.year_from > self.year_to:
            raise ValueError("the first year is after the last")

    def next_page(self) -> SearchQuery:
        return SearchQuery(**{**self.__dict__, "offset": self.offset + self.max_results})

    def is_first_page(self) -> bool:
        return self.offset == 0


#: Fixed value: the characters that the Lucene query syntax escapes.
_LUCENE = re.compile(r'([+\-&|!(){}\[\]^"~*?:/\\])')


def plain_booleans(term: str) -> str:
    """AND, OR, NOT to +, |, - and white space collapsed, as ``functions.text.boolean_to_symbols`` does for columns."""
    for word, sign in ((r"\bAND\b", "+"), (r"\bOR\b", "|"), (r"\bNOT\s+", "-")):
        term = re.sub(word, sign, term, flags=re.IGNORECASE)
    return " ".join(term.split())


def pubmed_pages(q: SearchQuery, found: str, key: str | None = None) -> Iterator[dict]:
    """Requests for the records of a PubMed search, from its answer: by the server's history if it names one, else by id."""
    answer = json.loads(found).get("esearchresult", {})
    ids, history = answer.get("idlist", []), {"query_key": answer.get("querykey", ""), "WebEnv": answer.get("webenv", "")}
    kept = all(history.values())  # the server's history begins at its first hit, the list of ids at the query's offset
    for at in range(0, min(int(answer.get("count", 0) or 0) - q.offset, q.max_results), FETCH_BATCH):
        part = ids[at : at + FETCH_BATCH]
        if not kept and not part:
            return
        where = {"retstart": q.offset + at, **history} if kept else {"retstart": at, "id": ",".join(part)}
        yield {"db": "pubmed", "step": "fetch", "retmode": "xml", "retmax": min(FETCH_BATCH, q.max_results - at)} | where | ({"api_key": key} if key else {})


def requests(source: str, q: SearchQuery, key: str | None = None) -> Iterator[dict]:
    """A source's own parameters, page by page; years are pushed down where the source can filter by them."""
    size = min(q.max_results, PAGE_SIZES[source])
    years = q.year_from is not None or q.year_to is not None
    low, high = q.year_from or 1000, q.year_to or 3000
    for at in range(q.offset, q.offset + q.max_results, size):
        if source == "openalex":
            yield {"search": q.term, "per-page": size, "page": at // size + 1} | ({"filter": f"publication_year:{low}-{high}"} if years else {})
        elif source == "crossref":
            yield {"query": q.term, "rows": size, "offset": at} | ({"filter": f"from-pub-date:{low},until-pub-date:{high}"} if years else {})
        elif source == "arxiv":
            yield {"search_query": f"all:{q.term}", "start": at, "max_results": size}
        elif source == "doaj":
            yield {"term": _LUCENE.sub(r"\\\1", q.term) + (f" AND bibjson.year:[{low} TO {high}]" if years else ""), "page": at // size + 1, "pageSize": size}
        elif source == "ieee":
            if not key:
                raise SourceUnavailable("no key")
            yield {"querytext": q.term, "start_record": at + 1, "max_records": size, "sort_field": "publication_year", "sort_order": "desc"} | ({"start_year": low, "end_year": high} if years else {})
        else:
            yield {"query": plain_booleans(q.term), "limit": size, "fields": "paperId,externalIds,title,abstract,year,venue,authors,citationCount"} | ({"year": f"{low}-{high}"} if years else {})


def read_pages(source: str, q: SearchQuery, transport: Transport, key: str | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Bodies of a source's pages.  A token source goes on until its last token; a page that fails ends the pages that
    were read before, which are kept, unless it is the first."""
    bucket = TokenBucket(RATES[source][1 if key else 0], sleep=sleep)
    if source == "pubmed":
        yield from _pubmed(q, transport, key, bucket, sleep)
        return
    got, token = 0, None
    for k, request in enumerate(requests(source, q, key)):
        if source == "semantic_scholar" and k and not token:
            return
        bucket.wait()
        try:
            body = with_retries(lambda r=request, t=token: transport(source, r | ({"token": t} if t else {})), sleep=sleep)
        except SourceUnavailable:
            if not got:
                raise
            return
        got += 1
        yield body
        if source == "semantic_scholar":
            try:
                token = json.loads(body).get("token")
            except ValueError:
                return


def _pubmed(q: SearchQuery, transport: Transport, key: str | None, bucket: TokenBucket, sleep: Callable[[float], None]) -> Iterator[str]:
    """A search for ids, then the records in batches; a batch that fails is left out, a search that fails is an error."""
    term = f"({q.term}) AND {q.year_from or 1000}:{q.year_to or 3000}[Date - Publication]" if q.year_from is not None or q.year_to is not None else q.term
    search = {"db": "pubmed", "step": "search", "term": term, "retmode": "json", "usehistory": "y", "retstart": q.offset, "retmax": q.max_results} | ({"api_key": key} if key else {})
    bucket.wait()
    found = with_retries(lambda: transport("pubmed", search), sleep=sleep)
    for request in pubmed_pages(q, found, key):
        bucket.wait()
        try:
            yield with_retries(lambda r=request: transport("pubmed", r), sleep=sleep)
        except SourceUnavailable:
            continue


@dataclass
class _Task(InputPartition):
    source: str


class SearchSource(DataSource):
    """spark.read.format("citeloom_search").option("query", json).load(): source, page, body, error.

    A partition is a source, so rate limits hold per source; a source that fails gives a row with its error and no
    body, and the others' rows are kept.
    """

    transport: Transport | None = None

    @classmethod
    def name(cls) -> str:
        return "citeloom_search"

    def schema(self) -> str:
        return "source string, page int, body string, error string, latency_ms long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, type(self).transport)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport | None):
        self.query = SearchQuery(**json.loads(options["query"]))
        self.sources = options["sources"].split(",")
        self.keys = json.loads(options.get("keys", "{}"))
        self.transport = transport

    def partitions(self) -> list[InputPartition]:
        return [_Task(s) for s in self.sources]

    def read(self, partition: _Task) -> Iterator[tuple]:
        began = time.monotonic()
        took = lambda: int((time.monotonic() - began) * 1000)
        try:
            for page, body in enumerate(read_pages(partition.source, self.query, self.transport, self.keys.get(partition.source))):
                yield partition.source, page, body, None, took()
        except Exception as e:  # one source's failure is a row, not the end of the search
            yield partition.source, -1, None, str(e), took()


def query_batch(text: str, only: list[str] | None = None, priority: str | None = None) -> list[tuple[str, SearchQuery]]:
    """The queries of a batch file (the YAML subset of nested maps and lists of scalars), filtered by id and priority."""
    out = []
    for q in parse_batch(text):
        if (only and q["id"] not in only) or (priority and q.get("metadata", {}).get("priority") != priority):
            continue
        out.append((q["id"], SearchQuery(q["text"], q.get("year_min"), q.get("year_max"), q.get("language"), q.get("max_results", 100), q.get("offset", 0), metadata=q.get("metadata", {}))))
    return out


def parse_batch(text: str) -> list[dict]:
    try:
        import yaml

        return yaml.safe_load(text)["queries"]
    except ImportError:
        pass
    queries: list[dict] = []
    nested: str | None = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#") or ":" not in bare:
            continue
        item, indent = bare.lstrip().startswith("- "), len(bare) - len(bare.lstrip())
        key, _, value = bare.lstrip().removeprefix("- ").partition(":")
        key, value = key.strip(), value.strip().strip("\"'")
        if item:
            queries.append({})
            nested, base = None, indent + 2
        if not queries:
            continue
        if not value:
            nested = key
            queries[-1][key] = {}
        elif nested and indent > base:
            queries[-1][nested][key] = value
        else:
            nested = None
            queries[-1][key] = int(value) if value.lstrip("-").isdigit() else value
    return queries
