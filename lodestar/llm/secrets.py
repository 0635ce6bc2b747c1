"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Patterns propose candidates; the hash of each candidate's secret is counted by distinct owners and distinct repositories over the
whole corpus. A secret that several owners carry, or that stands in many repositories of a few, is an example that was copied around;
one that is made up of a few characters or of the words of a placeholder was never live. What is left looks live. Spans of the three base
kinds are always reported, with that verdict and both counts; the wider patterns add a span only where the secret looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, stage
from .spans import find_all

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more
HEX = r"[0-9a-f]{16,}"
#: Formats of further credentials, as their issuers publish them.
WIDER = (
    r"gh[pousr]_[A-Za-z0-9]{30,}"
    r"|xox[abprs]-[A-Za-z0-9-]{20,}"
    r"|AIza[0-9A-Za-z_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
    r"|(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{20,}"
    r"|(?i:pwd|credential|access_key|auth_key|conn_string)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{16,}"
    r"|[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%+!-]{8,}@"
)
#: What goes before the secret itself in such a span, and behind it.
LEAD = r"^(?:(?i:bearer)\x20+|(?i:pwd|credential|access_key|auth_key|conn_string)[\"']?\x20*[:=]\x20*[\"']?|[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:)|@$"
#: Words of placeholders, and the fewest different characters of a secret that was drawn at random.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]|xxxx|12345678|abcdefgh|deadbeef"
LEAST_LETTERS = 6
KINDS = ("assign", "access", "hex", "wider")


def _candidates(text: Column) -> Column:
    """Array of (start, rank of the kind, end, hash of the secret, whether it is shaped like one that was drawn at random)."""
    assign = find_all(text, ASSIGN, text.rlike(ASSIGN))
    assign = F.filter(assign, lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 12)
    found = [
        (assign, lambda m: F.regexp_extract(m, ASSIGN, 2)),
        (find_all(text, ACCESS, F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS)), lambda m: m),
        (find_all(text, HEX, text.rlike(HEX)), lambda m: m),
        (find_all(text, WIDER, text.rlike(WIDER)), lambda m: F.regexp_replace(m, LEAD, "")),
    ]

    def drawn(m: Column) -> Column:
        return ~m.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(m, ""))) >= LEAST_LETTERS)

    def shaped(k: int, spans: Column, secret) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), F.sha2(secret(x["match"]), 256).alias("secret"), drawn(secret(x["match"])).alias("drawn")))

    parts = [shaped(k, spans, secret) for k, (spans, secret) in enumerate(found)]
    return F.array_sort(F.concat(*parts))


def scan(docs: DataFrame, owners: int = 3, repositories: int = 25, owner: str = "source", repository: str = "doc_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of (start, kind, end, n_owners, n_repositories, live).

    ``kind`` numbers KINDS. A secret is ``live`` if it is shaped like a drawn one and fewer than ``owners`` distinct owners and
    fewer than ``repositories`` distinct repositories carry it. Null and empty texts have no spans; texts are read whole, however
    long; null owners and repositories count as one of their own. Repeated rows each get their row, an empty table gives
    none, and further columns are not looked at.
    """
    name = {c: F.col(f"`{c}`") for c in (doc_id, owner, repository, text)}
    own = docs.select(name[doc_id].alias("doc_id"), F.coalesce(name[owner].cast("string"), F.lit("\0")).alias("owner"), F.coalesce(name[repository].cast("string"), F.lit("\0")).alias("repo"), _candidates(F.coalesce(name[text], F.lit(""))).alias("found"))
    own = stage(own.withColumn("rid", F.monotonically_increasing_id()), "candidates")
    each = own.select("rid", "owner", "repo", F.explode("found").alias("x")).select("rid", "owner", "repo", "x.*")
    stats = each.groupBy("secret").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repositories"))
    stats = stage(stats.withColumnRenamed("secret", "s"), "owners")
    live = F.col("drawn") & (F.col("n_owners") < owners) & (F.col("n_repositories") < repositories)
    told = each.join(checked_broadcast(stats), F.col("secret") == F.col("s")).withColumn("live", live)
    told = told.where(F.col("live") | (F.col("kind") < 3))
    spans = told.groupBy(F.col("rid").alias("r")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repositories", "live"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,n_owners:bigint,n_repositories:bigint,live:boolean>>")
    return own.select("rid", "doc_id").join(spans, F.col("rid") == F.col("r"), "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def digest(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each span, joined by commas, in the order given."""
    name = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
