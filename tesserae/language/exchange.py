"""Statements that take whole databases in and out: packages, wiki pages, reviewed submissions; traces; the frame that a new conversation starts from."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import functions as F

from ..operators import graph, versions
from ..sources import pages
from ..store import packages
from ..store.files import Files
from ..store.traces import Traces
from .compile import Bindings, constant
from .errors import StatementError
from .parser import Statement, parse

PROFILES = ("full", "titles")
WRITES = frozenset("insert update delete restore relate unrelate split merge".split())
MOST_STATEMENTS, FRAME_BYTES = 64, 12_000


class Exchange:
    """Part of a session."""

    # --- packages and pages

    def do_pack(self, s, bound, options):
        from .session import Result

        database, author = self._database(s.name[0]), constant(s["author"], bound)
        if not isinstance(author, str) or not author.strip():
            raise StatementError("validation_error", "a package has an author")
        path = options.get("path") or f"{self.log.root}/_packages/{database['database_id']}-{self.seen}"
        manifest = packages.pack(self.log, database["database_id"], path, options.get("key"), author=author)
        row = {"path": path, "database_id": database["database_id"], "author": author, "rows": manifest["rows"], "digest": manifest["digest"], "signed": "signature" in manifest}
        return Result(s.kind, list(row), [row])

    def do_open_package(self, s, bound, options):
        from .session import Result

        manifest, objects = packages.open_package(self.spark, constant(s["path"], bound), options.get("key"))
        rows = [r.asDict() for r in objects.groupBy("kind").agg(F.count("*").alias("objects")).orderBy("kind").collect()]
        return Result(s.kind, ["kind", "objects", "database_id"], [r | {"database_id": manifest["database_id"]} for r in rows])

    def do_install_package(self, s, bound, options):
        from .session import Result

        if self.open:
            raise StatementError("invalid_transaction_state", "packages aren't installed within a transaction")
        self._require("L2", None)
        last = packages.install(self.log, constant(s["path"], bound), options.get("key"), self.actor)
        self.refresh()
        return Result(s.kind, ["commit_sequence"], [{"commit_sequence": last}], affected=1)

    def do_export_wiki(self, s, bound, options):
        from .session import Result

        path, profile = constant(s["path"], bound), constant(s["profile"], bound)
        if profile not in PROFILES:
            raise StatementError("validation_error", f"no profile {profile}")
        out = None
        for t in self._visible("table", False):
            if not self._in_scope(t["database_id"]):
                continue
            source = self._source((self.catalog["database"][t["database_id"]]["name"], t["name"]))
            title = self._display(source)
            rows = self.rows(source)
            named = F.coalesce(F.col("c_" + title["column_id"]).cast("string"), F.col("row_id")) if title else F.col("row_id")
            lines = [F.concat(F.lit(f"- {c['name']}: "), F.col("c_" + c["column_id"]).cast("string")) for c in source.columns]
            body = F.lit(None).cast("string") if profile == "titles" else F.concat_ws("\n", *lines)
            part = rows.select("row_id", named.alias("title"), body.alias("body"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise StatementError("not_found", "there are no tables")
        edges = self._relations().select(F.col("source_row_id").alias("source_id"), "relation_type", F.col("target_row_id").alias("target_id"))
        done = pages.sync(self.spark, pages.render(out, edges), path)
        return Result(s.kind, list(done), [done], affected=done["written"] + done["removed"])

    # --- traces

    def record_trace(self, trace: dict) -> dict:
        self.refresh()
        if not self._in_scope(trace.get("database_id")):
            raise StatementError("not_found", "no such database")
        return Traces(self.spark, self.log.root).record(trace)

    def prune_traces(self, now: str) -> int:
        self._require("L2", None)
        return Traces(self.spark, self.log.root).prune(now)

    def _trace_scope(self, s: Statement) -> str | None:
        if self.allowed is not None and not s.name:
            raise StatementError("permission_denied", "a session of some databases names one")
        return self._database(s.name[0])["database_id"] if s.name else None

    def do_show_traces(self, s, bound, options):
        database, limit, traces = self._trace_scope(s), self._limit(s, bound, 256), Traces(self.spark, self.log.root)
        if s["after"] and s["cursor"]:
            raise StatementError("validation_error", "AFTER and CURSOR exclude each other")
        after, high, epoch = (constant(s["after"], bound) if s["after"] else 0), traces.high_water(), traces.epoch()
        if s["cursor"]:
            held = self._decoded(constant(s["cursor"], bound), ("after", "high", "epoch", "of"))
            if held["epoch"] != epoch:
                raise StatementError("revision_conflict", "traces have been pruned")
            if held["of"] != database:
                raise StatementError("validation_error", "this cursor belongs to another list")
            after, high = held["after"], held["high"]
        if not isinstance(after, int) or isinstance(after, bool) or after < 0:
            raise StatementError("validation_error", "AFTER takes a number from 0")
        out = self._collected(s.kind, traces.timeline(high, after, database).limit(limit + 1), limit)
        if out.truncated:
            out.cursor = self._encoded({"after": out.rows[-1]["trace_sequence"], "high": high, "epoch": epoch, "of": database})
        return out

    def do_show_trace(self, s, bound, options):
        database, wanted = self._trace_scope(s), constant(s["trace"], bound)
        files = Traces(self.spark, self.log.root).files
        if not isinstance(wanted, str) or "/" in wanted or not files.exists(f"bodies/{wanted}.json"):
            raise StatementError("not_found", f"no trace {wanted}")
        held = files.read_json(f"bodies/{wanted}.json")
        if database is not None and held["database_id"] != database:
            raise StatementError("not_found", f"no trace {wanted}")
        return self._page(s.kind, held["steps"], s, bound, 256, None, f"trace {wanted}")

    # --- submissions

    def _reviewed(self, database: dict, plan: Any) -> dict:
        if not isinstance(plan, dict) or not str(plan.get("submission_id") or "").strip() or "/" in plan["submission_id"]:
            raise StatementError("validation_error", "a submission has an id")
        statements = plan.get("statements")
        if not isinstance(statements, list) or not 1 <= len(statements) <= MOST_STATEMENTS:
            raise StatementError("validation_error", f"1 to {MOST_STATEMENTS} statements are needed")
        numbers, evidence = set(), set()
        for text, params in statements:
            one = parse(text)
            if one.kind not in WRITES:
                raise StatementError("unsupported_statement", f"{one.kind} can't be submitted")
            if one.name and self._database(one.name[0])["database_id"] != database["database_id"]:
                raise StatementError("permission_denied", "a statement goes to another database")
            given = params.values() if isinstance(params, dict) else params or []
            numbers |= {n for v in given if isinstance(v, (str, int)) and not isinstance(v, bool) for n in _numbers(str(v))}
        for x in plan.get("evidence", []):
            evidence |= set(_numbers(str(x)))
        digest = hashlib.sha256(json.dumps(plan, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()
        return {"submission_id": plan["submission_id"], "statements": len(statements), "unsupported_numbers": sorted(numbers - evidence), "plan_hash": digest}

    def do_review(self, s, bound, options):
        from .session import Result

        plan = bound.get(s["plan"][1]) if s["plan"][0] == "param" else None
        row = self._reviewed(self._database(s.name[0]), plan)
        return Result(s.kind, list(row), [row])

    def do_submit(self, s, bound, options):
        from .session import Result

        plan = bound.get(s["plan"][1]) if s["plan"][0] == "param" else None
        database = self._database(s.name[0])
        review = self._reviewed(database, plan)
        files = Files(self.spark, f"{self.log.root}/_receipts")
        files.make("")
        name = f"{database['database_id']}~{plan['submission_id']}.json"
        if files.exists(name):
            held = files.read_json(name)
            if held["plan_hash"] != review["plan_hash"]:
                raise StatementError("already_exists", "a submission of this id has other content")
            return Result(s.kind, list(held), [held])
        if options.get("approved_hash") != review["plan_hash"]:
            raise StatementError("permission_denied", "the plan's hash has to be approved")
        if review["unsupported_numbers"]:
            raise StatementError("constraint_violation", f"no evidence for {review['unsupported_numbers'][0]}")
        affected = 0
        for text, params in plan["statements"]:  # all go into this statement's commit
            one, own = parse(text), Bindings(params)
            affected += getattr(self, f"do_{one.kind}")(one, own, options).affected
            own.done()
        receipt = review | {"affected": affected, "commit_sequence": self.seen + 1}
        if not self.open:
            self._publish(options)
        files.publish(name, json.dumps(receipt, sort_keys=True).encode())
        return Result(s.kind, list(receipt), [receipt], affected=affected)

    def do_show_receipt(self, s, bound, options):
        from .session import Result

        database, wanted = self._database(s.name[0]), constant(s["receipt"], bound)
        files = Files(self.spark, f"{self.log.root}/_receipts")
        name = f"{database['database_id']}~{wanted}.json"
        if not isinstance(wanted, str) or not files.exists(name):
            raise StatementError("not_found", f"no receipt {wanted}")
        row = files.read_json(name)
        return Result(s.kind, list(row), [row])

    # --- the first frame

    def bootstrap(self, query: str, budget: int = FRAME_BYTES) -> list[dict]:
        """What a new conversation gets, within a byte budget: the atlas, what the query's words are found in, and the first routes of each table.
        The first part that doesn't fit ends the frame."""
        self.refresh()
        out: list[dict] = []
        size = 2

        def take(kind: str, rows: list[dict]) -> bool:
            nonlocal size
            for r in rows:
                item = {"part": kind} | r
                n = len(json.dumps(item, ensure_ascii=False, default=str).encode()) + bool(out)
                if size + n > budget:
                    return False
                size += n
                out.append(item)
            return True

        if not take("atlas", self.execute("SHOW CATALOG ATLAS LIMIT 64 COMPACT").rows):
            return out
        try:
            found = self.execute("SHOW LEXICAL LOCATIONS FROM ALL TABLES USING :q LIMIT 16 BYTES 65536", {"q": query}).rows
        except StatementError as e:
            if e.code != "validation_error":
                raise
            found = []  # a query without words
        if not take("location", found):
            return out
        for r in sorted((r for r in self.catalog["route"].values() if r["route_kind"] == "root" and r["_state"] == "live" and self._in_scope(r["database_id"])), key=lambda r: r["route_id"]):
            if not take("route", [self._shown_route(x) for x in self._children(r["route_id"])]):
                break
        return out

    # --- access by key

    def key_range(self, name: tuple[str, str], start: str | None, end: str | None, limit: int, after: str | None = None):
        """Live rows with ids from `start` up to but not including `end`, in the order of ids, after the id that a page ended with."""
        self.refresh()
        return versions.key_range(self.rows(self._source(name)), "row_id", start, end, limit, after)

    def relation_pages(self):
        live = versions.latest(self._versions("row"), "object_id").where("state = 'live'").select(F.col("object_id").alias("row_id"))
        edges = self._relations().select(F.col("source_row_id").alias("source_id"), "relation_type", F.col("target_row_id").alias("target_id"))
        return graph.relation_pages(edges, live)


def _numbers(text: str) -> list[str]:
    from ..functions import NUMBER

    import re

    return [m[0] for m in re.finditer(NUMBER, text)]
