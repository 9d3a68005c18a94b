"""The engine: a session's log with its decisions, and the ten verbs over them.

Everything is a DataFrame; a verb returns a new engine and never changes rows.
Decisions (marks) wait until ``commit``; folds stay addressed by their source's
digest, so that every verb can give the exact rows back.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import scalars as X
from .operators import forest as R
from .operators import transcript as T
from .policy import LEASE_GENERATIONS, MAX_MARKS, MIN_PEEK_BYTES, PIN_CAP, PLACEHOLDER_BYTES, Policy

FOLDS = "session long, fold string, start long, end long, brief string"
IDS = "session long, fold string"
ROWS = "session long, idx long"


class Refused(ValueError):
    """A verb that the policy or the state does not allow; the message says why."""


@dataclass(frozen=True)
class Engine:
    messages: DataFrame  # session, idx, role, text, nbytes, terminal
    folds: DataFrame  # FOLDS
    marks: DataFrame  # FOLDS
    expanded: DataFrame  # IDS, with left: generations of the lease
    pins: DataFrame  # ROWS
    policy: Policy

    @staticmethod
    def over(messages: DataFrame, policy: Policy) -> "Engine":
        spark = messages.sparkSession
        none = lambda schema: spark.createDataFrame([], schema)
        return Engine(messages, none(FOLDS), none(FOLDS), none(IDS + ", left int"), none(ROWS), policy)

    # ------------------------------------------------------------------ helpers
    def _one(self, fold: str, of: DataFrame | None = None) -> dict:
        found = (self.folds if of is None else of).where(F.col("fold") == fold).head(2)
        if len(found) != 1:
            raise Refused(f"no such fold: {fold}")
        return found[0].asDict()

    def _source(self, spans: DataFrame) -> DataFrame:
        keys = [c for c in spans.columns if c not in ("session", "start", "end")]
        return spans.join(self.messages, "session").where("idx >= start and idx < end").select("session", *keys, "idx", "role", "text", "nbytes")

    def tree(self) -> DataFrame:
        """Folds with their parent: the smallest fold that holds them."""
        p = self.folds.select("session", F.col("fold").alias("parent"), F.col("start").alias("a"), F.col("end").alias("b"))
        j = self.folds.join(p, "session", "left").where("fold = parent or a <= start and b >= end and (b - a > end - start)")
        best = F.min_by("parent", F.when(F.col("parent") != F.col("fold"), F.col("b") - F.col("a")))
        return j.groupBy("session", "fold", "start", "end", "brief").agg(best.alias("parent"))

    def shown(self) -> DataFrame:
        """Topmost folds that are not expanded; folds over pinned rows are shown as rows."""
        pinned = self.folds.join(self.pins, "session").where("idx >= start and idx < end").select("session", "fold").distinct()
        open_ = self.expanded.select("session", "fold").unionByName(pinned).distinct()
        closed = self.folds.join(open_, ["session", "fold"], "left_anti")
        above = closed.select("session", F.col("fold").alias("other"), F.col("start").alias("a"), F.col("end").alias("b"))
        inside = closed.join(above, "session").where("a <= start and b >= end and b - a > end - start").select("session", "fold").distinct()
        return closed.join(inside, ["session", "fold"], "left_anti")

    def projection(self) -> DataFrame:
        """session, place, kind, fold, text: what each session shows, in order."""
        v = self.shown()
        covered = self._source(v.select("session", "start", "end")).select("session", "idx")
        raw = self.messages.join(covered, ["session", "idx"], "left_anti").select("session", F.col("idx").alias("place"), F.lit("row").alias("kind"), F.lit(None).cast("string").alias("fold"), "text")
        return raw.unionByName(v.select("session", F.col("start").alias("place"), F.lit("fold").alias("kind"), "fold", F.concat(F.lit("[fold "), "fold", F.lit("] "), "brief").alias("text")))

    # -------------------------------------------------------------------- verbs
    def status(self, offset: int = 0, limit: int = 20) -> DataFrame:
        """Visible folds and what they save, a page of up to 100."""
        if not 1 <= limit <= 100 or offset < 0:
            raise Refused("limit must be from 1 to 100, offset 0 or more")
        s = self._source(self.shown()).groupBy("session", "fold", "brief").agg(F.min("idx").alias("start"), F.count("*").alias("rows"), F.sum("nbytes").alias("nbytes"))
        saved = F.greatest(F.col("nbytes") - PLACEHOLDER_BYTES - F.octet_length("brief"), F.lit(0))
        return s.withColumn("saved", saved).orderBy("session", "start").offset(offset).limit(limit)

    def peek(self, fold: str, offset: int = 0, nbytes: int = 16_000) -> DataFrame:
        """A bounded exact read of a fold's source: text, next offset, bytes left."""
        if nbytes < MIN_PEEK_BYTES or nbytes > 128_000 or offset < 0:
            raise Refused("bytes must be from 1,024 to 128,000, offset 0 or more")
        self._one(fold)
        rows = self._source(self.folds.where(F.col("fold") == fold).select("session", "fold", "start", "end"))
        whole = rows.groupBy("session", "fold").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("source"))
        size = F.octet_length("source")
        text = X.utf8_head(X.utf8_slice(F.col("source"), offset), nbytes)
        start = F.least(F.lit(offset), size) + (F.greatest(size - offset, F.lit(0)) - F.octet_length(X.utf8_slice(F.col("source"), offset)))
        end = start + F.octet_length("text")
        return whole.select("session", "fold", "source", text.alias("text")).select("session", "fold", "text", F.when(end < size, end).alias("next"), (size - end).alias("omitted"))

    def mark(self, spans: DataFrame) -> "Engine":
        """Pending folds (session, start, end and, if there is one, brief): each must be whole turns, unpinned and not fresh."""
        turns = T.complete_turns(self.messages)
        s = spans.select("session", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("brief") if "brief" in spans.columns else F.lit(None).cast("string")).alias("brief"))
        ends = s.join(turns.select("session", "start").withColumn("s", F.lit(1)), ["session", "start"], "left").join(turns.select("session", "end").withColumn("e", F.lit(1)), ["session", "end"], "left")
        if ends.where("s is null or e is null or end <= start").limit(1).count():
            raise Refused("a span must begin and end with complete turns")
        if s.join(self.pins, "session").where("idx >= start and idx < end").limit(1).count():
            raise Refused("a span holds pinned rows")
        crossing = s.join(self.folds.select("session", F.col("start").alias("a"), F.col("end").alias("b")), "session").where("(start < a and end > a and end < b) or (start > a and start < b and end > b)")
        if crossing.limit(1).count():
            raise Refused("a span cuts a fold")
        src = self._source(s.withColumn("key", F.concat_ws(":", "start", "end")))
        made = src.groupBy("session", "key", "brief").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.sha2(x["text"], 256)), ",").alias("digests"), F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.min_by("text", "idx").alias("first"))
        brief = F.coalesce("brief", X.bounded_subject(X.one_line(F.col("first")), R.BRIEF))
        new = made.select("session", F.concat(F.lit("fold_"), F.left(F.sha2(F.concat_ws("|", "session", "digests", "key"), 256), F.lit(24))).alias("fold"), "start", "end", F.left(brief, F.lit(self.policy.max_brief_chars)).alias("brief"))
        marks = self.marks.unionByName(new).dropDuplicates(["session", "fold"])
        if marks.groupBy("session").count().where(F.col("count") > MAX_MARKS).limit(1).count():
            raise Refused(f"a session may have {MAX_MARKS} marks")
        return replace(self, marks=marks)

    fold = mark

    def unmark(self, fold: str) -> "Engine":
        self._one(fold, self.marks)
        return replace(self, marks=self.marks.where(F.col("fold") != fold))

    def commit(self) -> "Engine":
        """All marks become folds at once."""
        return replace(self, folds=self.folds.unionByName(self.marks).dropDuplicates(["session", "fold"]), marks=self.marks.limit(0))

    def expand(self, fold: str) -> "Engine":
        """Show a fold's content (waiting marks are applied first) under a lease."""
        e = self.commit()
        own = e._one(fold)
        row = e.folds.where(F.col("fold") == fold).select("session", "fold", F.lit(LEASE_GENERATIONS).alias("left"))
        # what holds it has to be open as well
        outer = e.folds.where((F.col("session") == own["session"]) & (F.col("start") <= own["start"]) & (F.col("end") >= own["end"])).select("session", "fold", F.lit(LEASE_GENERATIONS).alias("left"))
        return replace(e, expanded=e.expanded.join(outer.select("fold"), "fold", "left_anti").select("session", "fold", "left").unionByName(outer.unionByName(row).distinct()))

    def refold(self, fold: str) -> "Engine":
        """Close a fold and all below it."""
        own = self._one(fold)
        inner = self.folds.where((F.col("session") == own["session"]) & (F.col("start") >= own["start"]) & (F.col("end") <= own["end"])).select("fold")
        return replace(self, expanded=self.expanded.join(inner, "fold", "left_anti").select("session", "fold", "left"))

    def generation(self) -> "Engine":
        """A generation passes: leases that reach 0 end."""
        return replace(self, expanded=self.expanded.withColumn("left", (F.col("left") - 1).cast("int")).where(F.col("left") > 0))

    def protect(self, rows: DataFrame) -> "Engine":
        """Pin rows (session, idx); refused beyond the cap's share of the budget."""
        pins = self.pins.unionByName(rows.select(F.col("session").cast("long").alias("session"), F.col("idx").cast("long").alias("idx"))).distinct()
        mass = self.messages.join(pins, ["session", "idx"]).groupBy("session").agg(F.sum("nbytes").alias("n")).where(F.col("n") > self.policy.zone_bytes(PIN_CAP))
        if mass.limit(1).count():
            raise Refused("pinned rows would pass the cap")
        return replace(self, pins=pins)

    def unprotect(self, rows: DataFrame) -> "Engine":
        return replace(self, pins=self.pins.join(rows.select("session", "idx"), ["session", "idx"], "left_anti"))

    def rebrief(self, fold: str, brief: str) -> "Engine":
        self._one(fold)
        if len(brief) > self.policy.max_brief_chars or sum(c.isalnum() for c in brief) < 3:
            raise Refused("a brief has three letters or digits and fits the cap")
        return replace(self, folds=self.folds.withColumn("brief", F.when(F.col("fold") == fold, F.lit(brief)).otherwise(F.col("brief"))))

    def reboundary(self, fold: str) -> "Engine":
        """Dissolve a fold: what it held is visible again."""
        self._one(fold)
        return replace(self, folds=self.folds.where(F.col("fold") != fold), expanded=self.expanded.where(F.col("fold") != fold))

    def recover(self, fold: str) -> DataFrame:
        """A fold's exact rows in order."""
        self._one(fold)
        return self._source(self.folds.where(F.col("fold") == fold).select("session", "fold", "start", "end")).orderBy("idx")

    def receipts(self) -> DataFrame:
        """The newest three folds of each session."""
        newest = F.row_number().over(W.partitionBy("session").orderBy(F.desc("start"), "fold"))
        return self.folds.withColumn("n", newest).where("n <= 3").drop("n")
