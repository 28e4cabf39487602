"""Merkle fixity audit of WARC archives, with DataFrame functions only.

Pages become WARC/1.1 resource records, in files of `per_file` consecutive page ids; the catalogue gives each record its
file and number, and in each replica its offset and length. A leaf is the SHA-256 of a record. An inner node hashes the ordered offset
ranges of up to `arity` children and their digests; the roots of the files are the leaves of one tree over the collection.
audit() compares the roots of two replicas and reads a level's nodes only below nodes that differ, down to the records.

Every level is written to the shared folder and has 1/arity of the rows below it. Groups hold `arity` rows at most.

Defined results: null url and html count as empty; null ids stand in a file of their own; rows that repeat an id are
records of their own, in order of their digest (an id is a key: rows that repeat one share a file, whose window grows with
them); a record that only one replica has is `missing` or `extra`; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC record; its bytes are UTF-8."""
    html = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def catalogue(pages: DataFrame, replicas: dict[str, Column], per_file: int = 1000) -> DataFrame:
    """file_no, record_no, page_id, and for each replica the digest of what it holds for the record (null: nothing), its offset
    and length there. replicas: name -> text of the record in that replica; all have the records in one order."""
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long").alias("file_no"), F.col("page_id").cast("long").alias("page_id"),
        *[x for name, c in replicas.items() for x in (F.sha2(c.cast("binary"), 256).alias(name), F.octet_length(c).cast("long").alias(f"{name}_length"))],
    )
    w = W.partitionBy("file_no").orderBy("page_id", *replicas)
    upto = lambda name: F.coalesce(F.sum(f"{name}_length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = [F.when(F.col(name).isNotNull(), upto(name)).alias(f"{name}_offset") for name in replicas]
    return rows.select("file_no", (F.row_number().over(w) - 1).cast("long").alias("record_no"), "page_id", *offsets, *[c for name in replicas for c in (name, f"{name}_length")])


def leaves(catalogued: DataFrame, replica: str) -> DataFrame:
    """(tree, node, size, digest): a record's bytes in this replica, and its digest."""
    return catalogued.where(F.col(replica).isNotNull()).select(F.col("file_no").alias("tree"), F.col("record_no").alias("node"), F.col(f"{replica}_length").alias("size"), F.col(replica).alias("digest"))


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level. A node's digest is over the offset ranges of its children, counted from its own start, and their digests."""
    kids = F.sort_array(F.collect_list(F.struct("node", "size", "digest")))
    got = level.groupBy("tree", F.floor(F.col("node") / arity).cast("long").alias("node")).agg(F.sum("size").alias("size"), kids.alias("kids"))
    stop = lambda i: F.aggregate(F.slice("kids", 1, i + 1), F.lit(0).cast("long"), lambda n, k: n + k["size"])
    text = F.transform("kids", lambda k, i: F.concat_ws(":", k["node"].cast("string"), (stop(i) - k["size"]).cast("string"), stop(i).cast("string"), k["digest"]))
    return got.select("tree", "node", "size", F.sha2(F.concat_ws("|", text).cast("binary"), 256).alias("digest"))


def levels(leaf: DataFrame, top: int, arity: int) -> list[DataFrame]:
    """The leaves and all levels above them, up to one node per tree; top: the greatest leaf number."""
    out = [leaf]
    while top > 0:
        out.append(written(parents(out[-1], arity), "merkle"))
        top //= arity
    return out


def differing(a: DataFrame, b: DataFrame, below: DataFrame | None, arity: int) -> DataFrame:
    """(tree, node) of a level whose digests differ or that one side lacks, under the nodes `below` only."""
    if below is not None:
        up = below.select("tree", F.col("node").alias("up"))
        a, b = (x.withColumn("up", F.floor(F.col("node") / arity).cast("long")).join(up, ["tree", "up"], "left_semi") for x in (a, b))
    a, b = a.select("tree", "node", F.concat_ws("|", "size", "digest").alias("a")), b.select("tree", "node", F.concat_ws("|", "size", "digest").alias("b"))
    return a.join(b, ["tree", "node"], "full").where("not (a <=> b)").select("tree", "node")


def audit(catalogued: DataFrame, a: str, b: str, arity: int = 16) -> DataFrame:
    """catalogued: from catalogue(), written. -> file_no, record_no, page_id, offset and length in a (in b, if a lacks it), and
    status: intact, corrupt, missing (b lacks it) or extra (a lacks it). Ranges count from the start of
    their node, so a record that one replica lacks, or that is longer there, moves no other branch."""
    place = [F.coalesce(f"{a}_{c}", f"{b}_{c}").alias(c) for c in ("offset", "length")]
    most = catalogued.agg(F.max("record_no").alias("r"), F.max("file_no").alias("f")).first()
    if most["r"] is None:
        return catalogued.select("file_no", "record_no", "page_id", *place, F.lit("intact").alias("status"))
    trees = {}
    for name in (a, b):
        within = levels(leaves(catalogued, name), most["r"], arity)
        # the files' roots are leaves of the tree of the collection; file -1 is number 0 there
        roots = within[-1].select(F.lit(0).cast("long").alias("tree"), (F.col("tree") + 1).alias("node"), "size", "digest")
        trees[name] = within, levels(roots, most["f"] + 1, arity)
    below = None
    for x, y in zip(reversed(trees[a][1]), reversed(trees[b][1])):
        below = written(differing(x, y, below, arity), "differing")
    # the roots that differ are where the search goes on in the files
    below = below.select((F.col("node") - 1).alias("tree"), F.lit(0).cast("long").alias("node"))
    for x, y in list(zip(reversed(trees[a][0]), reversed(trees[b][0])))[1:]:
        below = written(differing(x, y, below, arity), "differing")
    if len(trees[a][0]) == 1:  # files of one record: their roots are the records
        below = below.select("tree", "node")
    found = below.select(F.col("tree").alias("file_no"), F.col("node").alias("record_no"), F.lit(True).alias("differs"))
    status = F.when(F.col("differs").isNull(), "intact").when(F.col(b).isNull(), "missing").when(F.col(a).isNull(), "extra").otherwise("corrupt")
    return catalogued.join(found, ["file_no", "record_no"], "left").select("file_no", "record_no", "page_id", *place, status.alias("status"))


def damaged(page_id: Column, html: Column) -> Column:
    """What the second replica of the query holds of a page: letters of 64 characters of some are exchanged."""
    at = F.pmod(page_id * 7919, F.greatest(F.length(html), F.lit(1))).cast("int")
    hurt = F.concat(F.substring(html, F.lit(1), at), F.translate(html.substr(at + 1, F.lit(64)), "aeinorst", "einorsta"), html.substr(at + 65, F.length(html)))
    return F.when(page_id % 37 == 5, hurt).otherwise(html)


def audit_pages(pages: DataFrame) -> DataFrame:
    """The query: pages as archived, against a replica in which some records are corrupt and some are lost."""
    page_id, url, html = F.col("page_id"), F.col("url"), F.coalesce("html", F.lit(""))
    replicas = {"original": record(page_id, url, html), "replica": F.when(F.coalesce(page_id % 101, F.lit(0)) != 7, record(page_id, url, damaged(page_id, html)))}
    return audit(written(catalogue(pages, replicas), "catalogue"), "original", "replica")


SQL = r"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html, (page_id * 7919) % greatest(length(coalesce(html, '')), 1) as pos from pages),
d as (select *, case when page_id % 37 = 5 then substr(html, 1, pos) || translate(substr(html, pos + 1, 64), 'aeinorst', 'einorsta') || substr(html, pos + 65) else html end as hurt from p),
r as (select page_id, page_id // 1000 as file_no,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' as head,
  chr(13) || chr(10) || chr(13) || chr(10) as gap, html, hurt from d),
s as (select page_id, file_no, strlen(head || strlen(html) || gap || html || gap) as length, sha256(head || strlen(html) || gap || html || gap) as a,
  case when page_id % 101 <> 7 then sha256(head || strlen(hurt) || gap || hurt || gap) end as b from r),
o as (select *, row_number() over w - 1 as record_no, sum(length) over w - length as off from s window w as (partition by file_no order by page_id))
select file_no, record_no, page_id, cast(off as bigint) as "offset", cast(length as bigint) as length, case when b is null then 'missing' when a = b then 'intact' else 'corrupt' end as status from o
"""
