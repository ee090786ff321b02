"""Secret scan with corpus-wide ownership frequency.

Each text is scanned for base kinds (assign, access, hex) and for further candidates
(prefixed, key, token).  The hashes of all candidate values are then counted over the
whole corpus: for how many owners (sources) each occurs and in how many repositories
(documents, exact copies of a text being one).  A value that ``copied_owners`` or more
share is an example that was copied; one that a single owner has, in few repositories,
looks live; what lies between is shared.  All three are counted for each document; of
the further candidates those that are copied don't become spans, base spans always stay.
A private key is taken whole, to its END line, and hashed without its white space.

Counting is two aggregations, distinct (hash, owner, repository) and then by hash, each
combined map-side; the verdict on a hash goes back to the documents that hold it, where a
hot hash is split in parts by document (``join_spread``).  No table of hashes is collected.

Null texts are empty texts; a null owner is one owner; null ids are kept.  Repeated rows have
a row each and are one repository.  Texts of any length are scanned whole, in time linear in
them.  An empty table gives no row.  Columns other than id, owner and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialise
from .spans import Span, joined, sha256

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "prefixed", "key", "token")
ORDER = {k: i for i, k in enumerate(KINDS)}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
#: A maximal run of at least 24, as the matches of [0-9a-f]+ that are long enough.
HEX = re.compile(r"[0-9a-f]{24,}")
PREFIXED = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")
KEY = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
#: What follows the header: a body up to the END line; without one, runs of 16 or more characters.
KEY_BODY = re.compile(r"((?:[A-Za-z0-9+/=\s]|\\[nr])*+)-----END [A-Z ]{0,30}PRIVATE KEY-----")
KEY_RUNS = re.compile(r"((?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+)")
KEY_SPACE = re.compile(r"\s|\\[nr]")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def scan(text: str) -> tuple[list[Span], list[tuple[int, int, str, str]]]:
    """Base spans, and all candidates (start, end, kind, value)."""
    found: list[tuple[int, int, str, str]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    base = [(a, b, k) for a, b, k, _ in found]
    if any(p in text for p in ("gh", "sk_live_", "xox", "AIza")):
        found += [(m.start(), m.end(), "prefixed", m[0]) for m in PREFIXED.finditer(text)]
    if "-----BEGIN" in text:
        for m in KEY.finditer(text):
            body = KEY_BODY.match(text, m.end()) or KEY_RUNS.match(text, m.end())
            found.append((m.start(), body.end(), "key", KEY_SPACE.sub("", body[1]) or m[0]))
    for m in TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and v.lower() != v != v.upper() and entropy(v) >= 4.0 and not any(a < m.end() and m.start() < b for a, b, _ in base):
            found.append((m.start(), m.end(), "token", v))
    return base, found


def secrets(docs: DataFrame, owner_col: str = "source", id_col: str = "doc_id", text_col: str = "text", copied_owners: int = 3, live_repositories: int = 8, most: int = 1_000_000) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, n_copied, max_owners.

    A value held by copied_owners or more owners is copied; one of a single owner in at most live_repositories repositories
    looks live.  most: rows of one hash in a task, about.
    """
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.monotonically_increasing_id().alias("rid"), id_col, F.col(owner_col).cast("string").alias("owner"), text_col)
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, list[int]] = {k: [] for k in BASE}
            sha, cands, repositories = [], [], []
            for t in b.column(3):
                text = t.as_py() or ""
                base, found = scan(text)
                for k in BASE:
                    n[k].append(sum(s[2] == k for s in base))
                sha.append(sha256(joined(base, ORDER)))
                cands.append([{"start": a, "end": e, "kind": k, "hash": sha256(v)} for a, e, k, v in found])
                repositories.append(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) if found else 0)
            columns = [*b.columns[:3], *[pa.array(n[k], pa.int64()) for k in BASE], pa.array(sha, pa.string()), pa.array(repositories, pa.int64()), pa.array(cands, pa.list_(struct))]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", id_col, "owner", "n_assign", "n_access", "n_hex", "base_sha256", "repository", "cands"])

    found = materialise(src.mapInArrow(run, f"rid bigint, `{id_col}` {kind}, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, repository bigint, cands array<struct<start:bigint,end:bigint,kind:string,hash:string>>"), "secrets")
    each = found.select("rid", "owner", "repository", F.explode("cands").alias("c")).select("rid", "owner", "repository", "c.*")
    held = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    owned = materialise(held.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n")), "secretowners")
    judged = join_spread(each.drop("owner", "repository"), owned, "hash", "n", "rid", most)
    live = (F.col("n_owners") == 1) & (F.col("n_repositories") <= live_repositories)
    copied = F.col("n_owners") >= copied_owners
    rank = F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k, ORDER[k])]), F.col("kind"))
    per = judged.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind").isin(*BASE) | ~copied, F.struct("start", rank.alias("rank"), "end", "kind")))).alias("all"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum((~live & ~copied).cast("long")).alias("n_shared"),
        F.sum(copied.cast("long")).alias("n_copied"),
        F.max("n_owners").alias("max_owners"),
    )
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per = per.select("rid", text.alias("spans"), "n_live", "n_shared", "n_copied", "max_owners")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.drop("cands", "owner", "repository").join(per, "rid", "left").select(id_col, "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_shared"), zero("n_copied"), zero("max_owners"))
