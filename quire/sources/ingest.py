"""Steps of ingestion: which extractor, names of assets, what may be fetched, what is recorded once, and chains of steps with retries."""

from __future__ import annotations

import ipaddress
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.text import let
from ..scratch import drop_folder, materialize, path_exists, read_text, write_once

# Types of images that are fetched, with their endings, and the largest size.
IMAGE_TYPES = {"image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg"}
IMAGE_BYTES = 10 * 1024 * 1024
# Names of this machine and its network; networks that are not public, by first address and length of prefix.
INTERNAL_NAMES = r"^(.*\.)?(localhost|local|internal|localdomain|home\.arpa)$"
INTERNAL_4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3)]
INTERNAL_6 = [("100::", 64), ("2001::", 32), ("2001:db8::", 32), ("3fff::", 20), ("5f00::", 16), ("64:ff9b:1::", 48), ("fc00::", 7), ("fe80::", 10), ("fec0::", 10), ("ff00::", 8)]
# Networks whose addresses hold one of version 4, and the 16-bit group in which that begins.
HOLDS_4 = [("::", 96, 6), ("::ffff:0:0", 96, 6), ("::ffff:0:0:0", 96, 6), ("64:ff9b::", 96, 6), ("2002::", 16, 1)]


def extractor(provider: Column, used: Column) -> Column:
    """The extractor a document is labelled with: the vision model if that is set, else what the default path says it used."""
    return F.when(F.lower(F.trim(F.coalesce(provider, F.lit("")))) == "vlm", "vlm").otherwise(used)


def stored_assets(files: DataFrame) -> DataFrame:
    """document_id, original_name, file_path, mime_type of extracted files (document_id, path): a name of its own for each, its ending kept (.png if none).

    The name is a hash of document and path, so that a rerun stores a file in the same place.
    """
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.coalesce(F.nullif(F.regexp_extract(name, r"(\.[^.]+)$", 1), F.lit("")), F.lit(".png"))
    stored = F.concat("document_id", F.lit("/"), F.substring(F.sha2(F.concat_ws("\n", "document_id", "path"), 256), 1, 32), ending)
    kind = F.lower(ending)
    mime = F.when(kind.isin(".jpg", ".jpeg"), "image/jpeg").when(kind == ".gif", "image/gif").when(kind == ".webp", "image/webp").when(kind == ".svg", "image/svg+xml").otherwise("image/png")
    return files.select("document_id", name.alias("original_name"), stored.alias("file_path"), mime.alias("mime_type"))


def _number(part: Column) -> Column:
    """A part of an address of version 4: decimal, octal after a 0, hexadecimal after 0x; null if it is none."""
    base = F.when(part.rlike("^0x[0-9a-f]{1,12}$"), F.conv(F.substring(part, F.lit(3), F.length(part)), 16, 10)).when(part.rlike("^0[0-7]{1,12}$"), F.conv(part, 8, 10)).when(part.rlike("^(0|[1-9][0-9]{0,11})$"), part)
    return base.try_cast("long")


def _address_4(host: Column) -> Column:
    """The 32-bit number of a host that is written as one to four numbers, the last of which fills what is left; null if it is none."""

    def number(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        head = F.aggregate(F.slice(parts, F.lit(1), n - 1), F.lit(0).cast("long"), lambda acc, p: acc * 256 + F.when(p < 256, p))
        room = F.get(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), n - 1)
        return F.when((n <= 4) & (last < room), head * room + last)

    return let(F.transform(F.split(host, r"\."), lambda part: let(part, _number)), number)


def _within(number: Column, first: int, drop: int) -> Column:
    return F.shiftrightunsigned(number, drop) == first >> drop


def _internal_4(number: Column) -> Column:
    return reduce(lambda a, b: a | b, [_within(number, int(ipaddress.IPv4Address(a)), 32 - n) for a, n in INTERNAL_4])


def _groups_6(host: Column) -> Column:
    """The eight 16-bit groups of an address of version 6 in brackets, the zone left out; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), "%.*$", "")
    pair = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535))))
    plain = let(bare, lambda h: F.when(h.contains("."), F.concat(F.regexp_extract(h, "^(.*:)", 1), let(_address_4(F.substring_index(h, ":", -1)), pair))).otherwise(h))
    halves = F.transform(F.split(plain, "::", -1), lambda side: F.filter(F.split(side, ":"), lambda g: g != ""))

    def joined(halves: Column) -> Column:
        first, second = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
        both = F.concat(first, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(first) - F.size(second), F.lit(0))), second)
        return F.when(F.size(halves) == 2, both).when(F.size(halves) == 1, first)

    def numbers(groups: Column) -> Column:
        return F.when((F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(groups, lambda g: F.conv(g, 16, 10).cast("long")))

    return let(let(halves, joined), numbers)


def _internal_6(groups: Column) -> Column:
    def within(address: str, length: int) -> Column:
        own = [int(ipaddress.IPv6Address(address)) >> 112 - 16 * i & 65535 for i in range(8)]
        return reduce(lambda a, b: a & b, [_within(at(i), own[i], max(0, 16 * (i + 1) - length)) for i in range(-(-length // 16))])

    at = lambda i: F.get(groups, F.lit(i))
    held = [within(a, n) & let(at(i) * 65536 + at(i + 1), _internal_4) for a, n, i in HOLDS_4]
    return reduce(lambda a, b: a | b, [within(a, n) for a, n in INTERNAL_6] + held)


def url_refusal(url: Column) -> Column:
    """Why a URL may not be fetched: no web address, no host, an internal host by name or number; null if it may.

    Addresses are read as numbers, in every way of writing them (decimal, octal, hexadecimal,
    fewer than four parts, version 4 inside version 6), and held against networks that are not
    public. What looks like an address and is none, a name of one part, and a name that ends
    in a number are internal. Names are not resolved here.
    """
    u = F.coalesce(url, F.lit(""))
    web = u.rlike(r"^(?i)https?://") & ~u.rlike(r"[\s\\\x00-\x1f]")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), r"\.+$", "")

    def internal(host: Column) -> Column:
        numeric = F.element_at(F.split(host, r"\."), -1).rlike("^(0x[0-9a-f]*|[0-9]+)$")
        by_name = host.rlike(INTERNAL_NAMES) | ~host.contains(".") | host.contains("%")
        return F.when(host == "", "no host").when(
            F.when(host.startswith("["), F.coalesce(let(_groups_6(host), _internal_6), F.lit(True))).when(numeric, F.coalesce(let(_address_4(host), _internal_4), F.lit(True))).otherwise(by_name), "internal host"
        )

    return F.when(~web, "not a web address").otherwise(let(host, internal))


def fetched_image(content_type: Column, content: Column) -> Column:
    """Struct of refusal (a type that is not an image's, too many bytes; null if none) and the name that its content gives it."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    ending = F.try_element_at(F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv]), kind)
    refusal = F.when(ending.isNull(), "type").when(F.octet_length(content) > IMAGE_BYTES, "size")
    return F.struct(refusal.alias("refusal"), F.when(refusal.isNull(), F.concat(F.substring(F.sha2(content, 256), 1, 16), ending)).alias("name"))


def mode_once(log: DataFrame) -> DataFrame:
    """document_id, mode, reason: the first mode recorded of each document stands; log: document_id, at, mode, reason."""
    first = F.min_by(F.struct("mode", "reason"), F.struct("at", "mode", "reason"))
    return log.where("mode is not null").groupBy("document_id").agg(first.alias("x")).select("document_id", "x.mode", "x.reason")


def run_chain(documents: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame], int]], log: str | None = None) -> DataFrame:
    """document_id, step, attempt, ok: the log of a chain of steps over documents (document_id).

    A step (name, function, retries) takes the documents that all steps before have passed
    and tells for each whether it worked; those that failed are tried again, up to so many
    times more, and go no further if they never work. A failure of one does not stop others.

    With log, a folder, the log lasts: a chain that is run again on it goes on after the last
    attempt that was finished, with the documents that it began with. An attempt is announced
    before it starts and published once when it ends; of two drivers on one log the first to
    publish an attempt is right, and the other goes on from its outcome. A step whose driver
    is lost before that is done again, so steps should do no harm when they are repeated.
    """
    spark = documents.sparkSession

    def kept(name: str, work: Callable[[], DataFrame]) -> DataFrame:
        if log is None:
            return materialize(work(), "chain")
        mark = f"{log.rstrip('/')}/done/{name}.json"
        if not path_exists(spark, mark):
            own = f"data/{name}-{uuid.uuid4().hex}"
            write_once(spark, f"{log.rstrip('/')}/begun/{own[5:]}.json", "{}")
            rows = work()
            rows.write.parquet(f"{log.rstrip('/')}/{own}")
            if not write_once(spark, mark, json.dumps({"folder": own, "schema": rows.schema.json()})):
                drop_folder(spark, f"{log.rstrip('/')}/{own}")
        done = json.loads(read_text(spark, mark))
        return spark.read.schema(StructType.fromJson(json.loads(done["schema"]))).parquet(f"{log.rstrip('/')}/{done['folder']}")

    left = documents.select("document_id").distinct()
    if log is not None:
        left = kept("documents", lambda first=left: first)
    whole = None
    for at, (name, work, retries) in enumerate(steps):
        passed = None
        for attempt in range(1, retries + 2):
            outcome = lambda left=left, attempt=attempt: work(left).select("document_id", F.lit(name).alias("step"), F.lit(attempt).alias("attempt"), F.coalesce("ok", F.lit(False)).alias("ok"))
            did = kept(f"{at:03d}-{attempt:03d}", outcome)
            whole = did if whole is None else whole.union(did)
            good = did.where("ok").select("document_id")
            passed = good if passed is None else passed.union(good)
            left = did.where("not ok").select("document_id")
            if left.isEmpty():
                break
        left = passed
    return whole
