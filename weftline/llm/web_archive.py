"""WARC files with revisit records, and capture histories by an external merge of sorted index runs."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, attach_groups, open_shared, write_shared

_KEYS = ["_sha1", "_hash", "_bytes"]
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of archives that a task reads back.
READ_BYTES = 32 << 20
_HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)"
_NUMBER = r"^-?[0-9]{1,37}$"
_DIGITS = re.compile(_NUMBER.encode())


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, then the rest, lower-cased: com,example)/path?query. No URL: empty."""
    url = F.coalesce(url, F.lit(""))
    host, port, rest = (F.regexp_extract(url, _HOST, i) for i in (1, 2, 3))
    labels = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")
    key = F.concat(F.array_join(F.reverse(labels), ","), port, F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(F.lower(rest)))
    return F.when(url.rlike(_HOST), key).otherwise(F.lower(url))


def _number(page: Column) -> Column:
    """An id as a number, null where its text is none; a table's ids are all numbers or all texts."""
    return F.when(page.cast("string").rlike(_NUMBER), page.cast("string").cast("decimal(38,0)"))


class LoserTree:
    """Merges sorted iterators; each next item costs one comparison a level, against the losers on its path."""

    def __init__(self, runs: Iterable[Iterator]):
        self._runs = [iter(r) for r in runs]
        k = max(len(self._runs), 1)
        self._head = [next(r, None) for r in self._runs] or [None]
        self._lost = [-1] * k
        for run in range(k):
            self._replay(run)

    def _less(self, a: int, b: int) -> bool:
        x, y = self._head[a], self._head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, run: int) -> None:
        at, k = (run + len(self._lost)) // 2, len(self._lost)
        while at and k > 1:
            other = self._lost[at]
            if other == -1:  # still being filled: wait here for the other side
                self._lost[at] = run
                return
            if self._less(other, run):
                self._lost[at], run = run, other
            at //= 2
        self._winner = run

    def __iter__(self):
        while (item := self._head[self._winner]) is not None:
            yield item
            run = self._winner
            self._head[run] = next(self._runs[run], None)
            self._replay(run)


def _record(kind: str, record_id: str, url: str, date: str, digest: str, payload: bytes, length: int, refers: str | None, mime: str) -> bytes:
    """One gzip member with one record; a revisit has the HTTP head only, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict:
    """The headers of a record under lower-case names, http (its head) and payload (bytes)."""
    data = zlib.decompress(data, 31)
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("this is no WARC record")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = body[: int(out["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return out | {"http": {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


# An index run: lines in order, cut into ranges; then the ranges' places and their number.


def _line(key: str, stamp: str, page: str, file: str, at: int, size: int) -> bytes:
    return f"{key} {stamp} {page} {file} {at} {size}\n".encode()


def _order(line: bytes) -> tuple:
    key, stamp, page = line.split(b" ", 3)[:3]
    return key, stamp, int(page[1:]) if _DIGITS.match(page[1:]) else -1, page


def _run_parts(lines: Iterable[bytes], bounds: list[tuple[bytes, bytes]]) -> Iterator[bytes]:
    places, at = [0], 0
    for line in lines:
        while len(places) <= len(bounds) and tuple(line.split(b" ", 2)[:2]) >= bounds[len(places) - 1]:
            places.append(at)
        at += len(line)
        yield line
    places += [at] * (len(bounds) + 2 - len(places))
    yield struct.pack(f"<{len(places)}QQ", *places, len(places))


def _read_range(path: str, n: int, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The lines of range n of a run, a chunk at a time."""
    system, path = open_shared(path)
    with system.open_input_file(path) as f:
        size = f.size()
        count = struct.unpack("<Q", f.read_at(8, size - 8))[0]
        at, end = struct.unpack("<QQ", f.read_at(16, size - 8 - 8 * count + 8 * n))
        rest = b""
        while at < end:
            data = f.read_at(min(chunk, end - at), at)
            at += len(data)
            *lines, rest = (rest + data).split(b"\n")
            for x in lines:
                yield x + b"\n"


def write_archives(pages: DataFrame, folder: str, bounds: list[tuple[bytes, bytes]]) -> DataFrame:
    """Write a WARC file and an index run per partition of pages (id, url, date, payload, sha1 hex, bytes, first, key), sorted by (key, date, id); return (part, warc, run)."""

    def write(batches):
        import pyarrow as pa

        part, lines, count = TaskContext.get().partitionId(), [], 0
        warc = f"{folder}/part-{part:06d}.warc.gz"

        def records():
            nonlocal count
            at = 0
            for b in batches:
                for page, url, date, payload, sha1, size, first, key in zip(*[b.column(i).to_pylist() for i in range(8)], strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    response = first is None or first == page
                    data = _record("response" if response else "revisit", f"urn:page:{page}", url, date, digest, payload if response else b"", size, None if response else f"urn:page:{first}", "text/html; charset=utf-8")
                    lines.append(_line(key, _stamp(date).decode(), f"p{page}", warc.rpartition("/")[2], at, len(data)))
                    at, count = at + len(data), count + 1
                    yield data

        write_shared(warc, records())
        if count:
            run = f"{folder}/run-0-{part:06d}.cdx"
            write_shared(run, _run_parts(lines, bounds))
            yield pa.RecordBatch.from_pydict({"part": [part], "warc": [warc], "run": [run]})

    return pages.mapInArrow(write, "part long, warc string, run string")


def merge_runs(scratch: Scratch, parts: DataFrame, ranges: int, fan_in: int) -> DataFrame:
    """Capture histories in global order: (range, place, key, stamp, page, file, at, size), from sorted index runs (part, run).

    While there are over fan_in runs, groups of fan_in are merged into longer runs, one task a group and range; then one
    task a range merges what is left. A task holds a chunk of each of its runs; runs are listed in tables only.
    """
    level, folder = 0, scratch.folder("merged")
    runs = parts.select(F.col("part").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))).alias("n"), F.col("run").alias("path"))
    most = parts.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0] + 1  # a run has a number below this

    def jobs(group):
        """(g, n, paths): up to fan_in runs each."""
        todo = runs.groupBy(group.cast("long").alias("g"), "n").agg(F.sort_array(F.collect_list(F.struct("g", "path"))).alias("_r")).select("g", "n", F.col("_r.path").alias("paths"))
        return todo.repartition(max(1, min(ranges * max(-(-most // fan_in), 1), 100_000)), "g", "n")

    while most > fan_in:
        level += 1

        def merge(batches, level=level):
            import pyarrow as pa

            for b in batches:
                for job in b.to_pylist():
                    n = job["n"]
                    path = f"{folder}/run-{level}-{job['g']:06d}-{n:06d}.cdx"
                    tree = LoserTree(((_order(x), x) for x in _read_range(p, n)) for p in job["paths"])

                    def parts(tree=tree, n=n):
                        size = 0
                        for _, line in tree:
                            size += len(line)
                            yield line
                        places = [0] * (n + 1) + [size]
                        yield struct.pack(f"<{len(places)}QQ", *places, len(places))

                    write_shared(path, parts())
                    yield pa.RecordBatch.from_pydict({"g": [job["g"]], "n": [n], "path": [path]})

        runs = scratch.table(jobs(F.floor(F.col("g") / fan_in)).mapInArrow(merge, "g long, n long, path string"), f"level{level}")
        most = -(-most // fan_in)

    def last(batches):
        import pyarrow as pa

        for b in batches:
            for job in b.to_pylist():
                tree, rows = LoserTree(((_order(x), x) for x in _read_range(p, job["n"])) for p in job["paths"]), []
                for place, (_, line) in enumerate(tree):
                    key, stamp, page, file, at, size = line.decode().rstrip("\n").rsplit(" ", 5)
                    rows.append((job["n"], place, key, stamp, page[1:], file, int(at), int(size)))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    names = ["range", "place", "key", "stamp", "page", "file", "at", "size"]
    return jobs(F.lit(0)).mapInArrow(last, "range long, place long, key string, stamp string, page string, file string, at long, size long")


def build_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, least_bytes: int = 0, fan_in: int = 64) -> tuple[DataFrame, str, Scratch]:
    """(capture histories, folder of the WARC files, scratch); see archive_pages."""
    spark = df.sparkSession
    scratch = Scratch(spark, "warc")
    date = F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.regexp_replace(F.col(url_col).cast("string"), r"\s", "%20"), F.lit("")).alias("_url"), date.alias("_date"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8").alias("_payload"))
    rows = rows.withColumns({"_sha1": F.unhex(F.sha1("_payload")), "_hash": F.xxhash64("_payload"), "_bytes": F.octet_length("_payload"), "_salt": F.xxhash64("_id", "_url")})
    rows = rows.withColumn("_date", F.coalesce("_date", _date(F.col("_id"))))
    narrow = scratch.table(rows.select("_id", "_url", "_date", *_KEYS), "narrow")
    total = narrow.count()
    groups = scratch.table(narrow.filter(F.col("_bytes") >= least_bytes).groupBy(*_KEYS).agg(F.max("_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    parts = max(1, min(total // 2000 + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # bounds of the index's ranges, from a sample of at most about 20,000 keys; they only balance the ranges
    sample = narrow.select(url_key(F.col("_url")).alias("key"), "_date").sample(min(1.0, 20_000 / max(total, 1)), 7)
    cuts = sorted((r.key.encode(), _stamp(r._date)) for r in sample.collect())
    bounds = sorted({cuts[len(cuts) * i // parts] for i in range(1, parts)}) if cuts else []
    rows = attach_groups(rows, groups, _KEYS, "_salt", total)
    rows = rows.withColumn("_key", url_key(F.col("_url")))
    rows = rows.select("_id", "_url", "_date", "_payload", F.lower(F.hex("_sha1")).alias("_sha1"), "_bytes", "first", "_key")
    rows = rows.sortWithinPartitions("_key", "_date", F.coalesce(_number(F.col("_id")), F.lit(-1)), F.coalesce(F.col("_id").cast("string"), F.lit("None")))
    folder = scratch.folder("archives")
    written = scratch.table(write_archives(rows, folder, bounds), "parts")
    scratch.drop("narrow")
    return scratch.table(merge_runs(scratch, written, len(bounds) + 1, fan_in), "histories"), folder, scratch


def _date(page: Column) -> Column:
    """A capture without a date gets the first second of 2020 plus its id's seconds, within 30 years; 2020 itself, where the id is no number."""
    n = F.coalesce(F.pmod(_number(page), F.lit(30 * 365 * 86400)), F.lit(0)).cast("int")
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.floor(n / 86400).cast("int")).cast("string")
    return F.format_string("%sT%02d:%02d:%02dZ", day, F.floor(n / 3600) % 24, F.floor(n / 60) % 60, n % 60)


def _stamp(date: str) -> bytes:
    return re.sub(r"\D", "", date).encode()


def read_captures(histories: DataFrame, folder: str) -> DataFrame:
    """Read the record of each capture from the archives, a file's records in one task in file order; digests of responses are computed from their payloads."""

    def read(batches):
        import pyarrow as pa

        name, file = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["file"] != name:
                    system, path = open_shared(f"{folder}/{r['file']}")
                    name, file = r["file"], system.open_input_file(path)
                rec = parse_record(file.read_at(r["size"], r["at"]))
                kind, page = rec["warc-type"], rec["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                digest, size = rec["warc-payload-digest"].removeprefix("sha1:"), int(rec["http"]["content-length"])
                if kind == "response":
                    own = base64.b32encode(hashlib.sha1(rec["payload"]).digest()).decode()
                    if own != digest or size != len(rec["payload"]):
                        raise ValueError(f"the record of page {page} in {name} is damaged")
                refers = rec.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                out.append((page, size, digest, kind, refers or None, rec["warc-target-uri"], r["range"], r["place"]))
            if out:
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["page", "payload_bytes", "payload_digest", "record_type", "refers", "url", "range", "place"])

    tasks = histories.agg(F.coalesce(F.sum("size"), F.lit(0)) / READ_BYTES, F.count_distinct("file")).first()
    wide = int(histories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by the archives' bytes, not by those of their index
    todo = histories.select("file", "at", "size", "range", "place").repartition(max(1, int(tasks[0]), min(tasks[1], wide)), "file").sortWithinPartitions("file", "at")
    return todo.mapInArrow(read, "page string, payload_bytes long, payload_digest string, record_type string, refers string, url string, range long, place long")


def archive_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, least_bytes: int = 0, fan_in: int = 64) -> DataFrame:
    """Write df as WARC files and read them back: id_col, payload_bytes, payload_digest, record_type, refers_to, history_range, history_place.

    Of equal payloads of at least least_bytes bytes, that of the largest id is a response record and the others revisit
    it. (history_range, history_place) order all captures by URL key, date and id. A null payload counts as empty, a null
    URL as the empty URL. A null id stands as None in its record and comes back null; it is a response only where no
    equal payload has an id. Rows that repeat an id and payload each have a record, all of them responses if it is the
    largest. Very long payloads are written whole. An empty table gives an empty result. Other columns are not read.
    """
    kind = df.select(id_col).dtypes[0][1]
    histories, folder, _ = build_archives(df, id_col, url_col, payload_col, date_col, least_bytes, fan_in)
    rows = read_captures(histories, folder)
    back = {c: F.when(F.col(c) == "None", None).otherwise(F.col(c)).cast(kind) for c in ("page", "refers")}
    return rows.select(back["page"].alias(id_col), "payload_bytes", "payload_digest", "record_type", back["refers"].alias("refers_to"), F.col("range").alias("history_range"), F.col("place").alias("history_place"))


def op8_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
