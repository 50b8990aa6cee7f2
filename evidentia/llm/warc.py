"""WARC archives with a two-level capture index.

Pages are written as gzip members of WARC 1.1 files, one file per task, into a folder that all executors share. Equal
payloads (by SHA-256 and length) of at least `dedup_from` bytes are stored once, with the smallest page_id; the others
are revisit records that refer to it and its URL. Captures are then sorted by reversed-host key and page and packed
into compressed blocks (second level); a directory holds the first and last place of each block (first level). A
lookup bisects the slice of the directory that its sorted batch spans, reads that block by range, bisects the block,
both by key and page, so that a URL with any number of captures costs no more than others, and reads the record by
range. A revisit is followed: the responses that revisits name are looked up in the same way, each once, and size and
digest are those of the payload read there.

A file counts only through the rows that its task returned and that were then stored, so a file left by a lost or
repeated task is never read. Files are opened with pyarrow's file systems, by the URI of the folder. Ranges are cut by
the bytes and number of captures, not by those of their keys.

Defined results: a null html is an empty payload; a null url has the empty key; rows that repeat a page_id with the
same payload are all responses if it is the smallest; a null page_id comes after all others and is never referred to;
a page_id of any type that casts to a string and back will do; a payload travels whole, as one gzip member, however
long; the rows that share url and page_id are looked up by one task; an empty table gives an empty result; other
columns are not used.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, shared_path, stored

BLOCK_ROWS = 1000
#: Archived bytes and captures that one task of an index or a lookup takes.
TASK_BYTES, TASK_ROWS = 32 << 20, 50_000
DATE = "1970-01-01T00:00:00Z"
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)([^#]*)")


def surt(url: str | None) -> str:
    """Reversed-host key: https://m.site.org:80/a?b#c -> org,site,m:80)/a?b"""
    if not url:
        return ""
    m = _URL.match(url)
    if not m:
        return url.split("#")[0]
    host, _, port = m[1].lower().partition(":")
    rest = m[2] if m[2].startswith("/") else "/" + m[2]
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:", uri) else (fs.LocalFileSystem(), uri)


def _line(value) -> str:
    return re.sub(r"[\r\n]+", "%0A", "" if value is None else str(value))


def _urn(page: str | None) -> str:
    """A page's record id; pages of any text fit on a header line."""
    return f"<urn:page:{quote(page or '', safe='')}>"


def record(page: str | None, url, payload: bytes, digest: str, refers: tuple | None) -> bytes:
    """A WARC record; a revisit (`refers`: page and URL of the response) has the payload's headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers:
        head += [f"WARC-Refers-To: {_urn(refers[0])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        # a null URL has no such field, so that its key is found again
        head += [f"WARC-Refers-To-Target-URI: {quote(refers[1], safe=_PLAIN)}"] if refers[1] else []
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters of a referred URL that need no escape; `%` has one, so that the URL comes back as it was.
_PLAIN = "!#$&'()*+,/:;=?@[]~"


def parse(raw: bytes) -> dict:
    """Header fields in lower case, `payload` (None for a revisit) and `payload_bytes` of the whole payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record ends early")
    http, _, payload = block.partition(b"\r\n\r\n")
    out["payload_bytes"] = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    out["payload"] = None if out["warc-type"] == "revisit" else payload
    return out


def _page(name: str = "page_id"):
    """A page as the index has it: text that sorts by bytes, null first and apart from the empty text."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def write(pages: DataFrame, folder: str, dedup_from: int = 0) -> DataFrame:
    """Writes the archives below `folder`; returns captures: key, page (see `_page`), file, offset, length."""
    byte_batches(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", body.alias("payload")).withColumn("same", F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string")))
    order = F.when(F.col("page_id").isNotNull(), F.struct(F.col("page_id"), F.coalesce("url", F.lit(""))))
    several = own.filter(F.octet_length("payload") >= dedup_from).groupBy("same").agg(F.count("*").alias("n"), F.min_by(F.struct("page_id", "url"), order).alias("first"))
    # a table of its own, so that the join's sides are both plain exchanges and the rows of a hot payload can be split
    several = stored(several.filter("n > 1 and first is not null").select("same", "first"), "payloads")
    own = own.join(several, "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    own = own.select(_page().alias("page"), "url", "payload", F.when(revisit, F.col("first.page_id").cast("string")).alias("to_page"), F.col("first.url").alias("to_url"))

    def run(batches):
        import pyarrow as pa

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        file, at = f"{base}/warc-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
        out = None
        for batch in batches:
            rows = {"key": [], "page": [], "file": [], "offset": [], "length": []}
            out = out or fs.open_output_stream(file, compression=None)
            for page, url, payload, to_page, to_url in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                raw = gzip.compress(record(page[1:], url, payload, digest, None if to_page is None else (to_page, to_url)), 4, mtime=0)
                out.write(raw)
                for name, value in zip(rows, (_field(surt(url)), page, file, at, len(raw)), strict=True):
                    rows[name].append(value)
                at += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in (("key", pa.string()), ("page", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))], names=[*rows])
        if out:
            out.close()

    return stored(own.mapInArrow(run, "key string, page string, file string, offset long, length long"), "captures")


def _tasks(spark, rows: int, size: int) -> int:
    """How many tasks share `rows` records of `size` archived bytes."""
    return max(1, min(rows, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES), -(-rows // TASK_ROWS))))


def build_index(captures: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> str:
    """Packs sorted captures into compressed blocks below `folder`; returns where the block directory is stored."""
    spark = captures.sparkSession
    rows, size = captures.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    ordered = captures.repartitionByRange(_tasks(spark, rows, size), "key", "page", "offset").sortWithinPartitions("key", "page", "file", "offset")

    def run(batches):
        import pyarrow as pa

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        file = f"{base}/index-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.cdx"
        out, at, held, directory = None, 0, [], []

        def flush(rows):
            nonlocal out, at
            out = out or fs.open_output_stream(file, compression=None)
            raw = zlib.compress("\n".join("\t".join((r[0], _field(r[1]), r[2], str(r[3]), str(r[4]))) for r in rows).encode())
            out.write(raw)
            directory.append((rows[0][0], rows[0][1], rows[-1][0], rows[-1][1], file, at, len(raw)))
            at += len(raw)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                if len(held) == block_rows:
                    flush(held)
                    held = []
        if held:
            flush(held)
        if out:
            out.close()
        kinds = (pa.string(),) * 5 + (pa.int64(),) * 2
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in directory], t) for k, t in enumerate(kinds)], names=_ENTRY)

    path = shared_path(spark, "directory")
    made = ordered.mapInArrow(run, "first_key string, first_page string, last_key string, last_page string, file string, offset long, length long")
    made.sortWithinPartitions("first_key", "first_page", "file", "offset").write.parquet(path)
    return path


_ENTRY = ["first_key", "first_page", "last_key", "last_page", "file", "offset", "length"]


def _field(key: str) -> str:
    """A field of a block without the characters that part fields and rows."""
    return key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


class Reader:
    """Lookups by key and page over the two levels; few open files and one open block at a time."""

    def __init__(self, directory: str):
        import pyarrow.dataset as ds

        fs, base = file_system(directory)
        self.directory, self.files, self.block = ds.dataset(base, filesystem=fs, format="parquet"), {}, (None, [])

    def span(self, low: tuple[str, str], high: tuple[str, str]) -> list[tuple]:
        """The directory's entries whose blocks may hold places (key, page) from `low` to `high`, in order."""
        import pyarrow.dataset as ds

        key, page = ds.field("last_key"), ds.field("last_page")
        after = (key > low[0]) | ((key == low[0]) & (page >= low[1]))
        key, page = ds.field("first_key"), ds.field("first_page")
        before = (key < high[0]) | ((key == high[0]) & (page <= high[1]))
        rows = self.directory.to_table(filter=after & before).select(_ENTRY).to_pydict()
        first = [(k.encode(), p.encode()) for k, p in zip(rows["first_key"], rows["first_page"], strict=True)]
        last = [(k.encode(), p.encode()) for k, p in zip(rows["last_key"], rows["last_page"], strict=True)]
        return sorted(zip(first, last, rows["file"], rows["offset"], rows["length"], strict=True))

    def bytes_at(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            fs, path = file_system(file)
            self.files[file] = fs.open_input_file(path)
        return self.files[file].read_at(length, offset)

    def rows(self, entry: tuple) -> list[tuple]:
        """The captures of a block: ((key, page) as bytes, file, offset, length)."""
        if self.block[0] != entry[2:4]:
            lines = zlib.decompress(self.bytes_at(*entry[2:])).decode().split("\n")
            cut = [x.split("\t") for x in lines]
            self.block = (entry[2:4], [((k.encode(), unquote(p).encode()), f, int(o), int(n)) for k, p, f, o, n in cut])
        return self.block[1]

    def captures(self, entries: list[tuple], place: tuple[bytes, bytes]):
        """Where the captures of a page under a key are: file, offset, length."""
        at = bisect.bisect_left(entries, place, key=lambda e: e[1])
        while at < len(entries) and entries[at][0] <= place:
            rows = self.rows(entries[at])
            low = bisect.bisect_left(rows, place, key=lambda r: r[0])
            while low < len(rows) and rows[low][0] == place:
                yield rows[low][1:]
                low += 1
            at += 1


_FOUND = "page string, payload_bytes long, payload_digest string, record_type string, to_page string, to_url string"


def _read(places: DataFrame, directory: str, tasks: int) -> DataFrame:
    """The record behind each row (key, page, digest) of `places`, and the row's `digest`.

    Without a digest the rows that share a place take its captures one by one; with one it is the response that has it.
    """
    ordered = places.repartitionByRange(tasks, "key", "page").sortWithinPartitions("key", "page")

    def run(batches):
        import pyarrow as pa

        reader, seen = Reader(directory), (None, 0)
        for batch in batches:
            if not len(batch):
                continue
            asked = [*zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            entries = reader.span(asked[0][:2], asked[-1][:2])
            out: list[list] = [[] for _ in range(6)]
            for key, page, digest in asked:
                seen = ((key, page), seen[1] + 1) if seen[0] == (key, page) else ((key, page), 0)
                for k, place in enumerate(reader.captures(entries, (key.encode(), page.encode()))):
                    if digest is None and k < seen[1]:
                        continue
                    found = parse(gzip.decompress(reader.bytes_at(*place)))
                    own = found["warc-payload-digest"].removeprefix("sha1:")
                    if digest is None or (found["payload"] is not None and own == digest):
                        break
                else:
                    raise KeyError(f"no capture of page {page[1:]} under {key[:80]}")
                if found["payload"] is not None and (len(found["payload"]) != found["payload_bytes"] or base64.b32encode(hashlib.sha1(found["payload"]).digest()).decode() != own):
                    raise ValueError(f"page {page[1:]}: the payload differs from its digest")
                to = found.get("warc-refers-to")
                to_url = found.get("warc-refers-to-target-uri")
                values = (page, found["payload_bytes"], own, found["warc-type"], unquote(to[len("<urn:page:") : -1]) if to else None, unquote(to_url) if to_url else None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return ordered.mapInArrow(run, _FOUND)


def _places(rows: DataFrame, url: str, *others) -> DataFrame:
    """`rows` with the key of their `url` as key, and the columns `others`."""
    plain = rows.select(F.col(url).alias("url"), *others)
    kinds = ", ".join(f"{c} {k}" for c, k in plain.dtypes[1:])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [_field(surt(u)) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), *batch.columns[1:]], names=["key", *batch.schema.names[1:]])

    return plain.mapInArrow(run, f"key string, {kinds}")


def look_up(wanted: DataFrame, directory: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to for each row (url, page_id) of `wanted`; runs jobs."""
    spark = wanted.sparkSession
    kind = wanted.schema["page_id"].dataType.simpleString()
    keyed = _places(wanted, "url", _page().alias("page"), F.lit(None).cast("string").alias("digest"))
    # the captures are as many as the rows asked for; their bytes follow from the directory's tail of each file
    entries = spark.read.parquet(directory)
    blocks, rows = entries.count(), wanted.count()
    tasks = _tasks(spark, max(rows, 1), blocks * TASK_BYTES // 8)
    found = stored(_read(keyed, directory, tasks), "records")
    page_id = F.when(F.col("page") != "", F.substring("page", 2, 1 << 30)).cast(kind)
    own = found.filter("record_type <> 'revisit'").select(page_id.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to"))
    again = found.filter("record_type = 'revisit'")
    targets = again.select("to_page", "to_url", "payload_digest").distinct()
    targets = stored(_places(targets, "to_url", F.concat(F.lit("="), "to_page").alias("page"), F.col("payload_digest").alias("digest")), "targets")
    many = targets.count()
    full = stored(_read(targets, directory, _tasks(spark, max(many, 1), many * TASK_BYTES // TASK_ROWS)), "responses")
    full = full.select(F.substring("page", 2, 1 << 30).alias("to_page"), "payload_digest", F.col("payload_bytes").alias("full_bytes"))
    met = again.join(full, ["to_page", "payload_digest"]).select(page_id.alias("page_id"), F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("to_page").cast(kind).alias("refers_to"))
    return own.unionByName(met)


def archive(pages: DataFrame, folder: str | None = None, dedup_from: int = 0) -> tuple[DataFrame, str]:
    """Writes archives and index; returns the captures and where the directory is."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    captures = write(pages, folder, dedup_from)
    return captures, build_index(captures, folder)
