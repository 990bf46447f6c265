import pytest

from tesserae.language.errors import StatementError
from tesserae.language.parser import parse
from tesserae.language.session import Session


@pytest.fixture()
def session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/store")
    s.execute("CREATE DATABASE d PURPOSE 'notes' SCOPE 'all'")
    s.execute("CREATE TABLE d.t (title TEXT(20) NOT NULL ROLE title, count INTEGER, done BOOLEAN, `at` TIMESTAMP) PURPOSE 'p' ROW SEMANTICS 'a note'")
    return s


def insert(s, **values):
    return s.insert_many(("d", "t"), [values])[0]


def code(f, *args, **options):
    with pytest.raises(StatementError) as e:
        f(*args, **options)
    return e.value.code


@pytest.mark.parametrize("text", ["SELECT", "SELECT a FROM t LIMIT 1", "SELECT a FROM d.t WHERE LIMIT 1", "INSERT INTO d.t VALUES ()", "SELECT a b FROM d.t LIMIT 1", "SHOW CATALOG ATLAS", "nonsense", "SELECT a FROM d.t WHERE a = 'x", ""])
def test_parse_errors(text):
    assert code(parse, text) == "parse_error"


def test_precedence():
    assert parse("SELECT a FROM d.t WHERE a = 1 OR b = 2 AND NOT c LIMIT 1")["where"] == ("bin", "OR", ("bin", "=", ("col", "a"), ("lit", 1)), ("bin", "AND", ("bin", "=", ("col", "b"), ("lit", 2)), ("un", "NOT", ("col", "c"))))
    assert parse("SELECT a FROM d.t WHERE 1 + 2 * -3 = 4 -- note\n /* x */ LIMIT 1;")["where"][2] == ("bin", "+", ("lit", 1), ("bin", "*", ("lit", 2), ("un", "-", ("lit", 3))))


def test_select(session):
    insert(session, title="alpha", count=4, done=True, at="2024-01-01T10:00:00+02:00")
    insert(session, title="be'ta -- x", count=-7)
    get = lambda where, p=None: sorted(r["title"] for r in session.execute(f"SELECT title FROM d.t WHERE {where} LIMIT 5", p).rows)
    assert get("count + 1 >= 5") == ["alpha"]
    assert get("done != NULL") == [] and len(get("NOT (done = NULL)")) == 2
    assert get("`AT` = '2024-01-01T08:00:00Z'") == ["alpha"]
    assert get("title = :x", {"x": "be'ta -- x"}) == ["be'ta -- x"]
    assert get("count / 2 = -3") == ["be'ta -- x"] and get("count % 4 = -3") == ["be'ta -- x"]
    assert code(session.execute, "SELECT title FROM d.t WHERE count = '1' LIMIT 1") == "validation_error"
    assert code(session.execute, "SELECT title FROM d.t WHERE done > FALSE LIMIT 1") == "validation_error"
    assert code(session.execute, "SELECT nope FROM d.t LIMIT 1") == "validation_error"
    assert code(session.execute, "SELECT title FROM d.t") == "validation_error"
    assert code(session.execute, "SELECT title FROM d.t WHERE count / 0 = 1 LIMIT 1") == "constraint_violation"
    assert code(session.execute, "SELECT title FROM d.t WHERE count = :a LIMIT 1", {"a": 1, "b": 2}) == "validation_error"
    assert session.execute("SELECT title FROM d.t WHERE row_id = 'row_none' LIMIT 1").rows == []


def test_versions(session):
    i = insert(session, title="one", count=1)
    assert session.execute("UPDATE d.t SET count = count + 1 WHERE row_id = :r", {"r": i}, expected_revision=1).affected == 1
    assert code(session.execute, "UPDATE d.t SET count = 9 WHERE row_id = :r", {"r": i}, expected_revision=1) == "revision_conflict"
    old = session.execute("SELECT count FROM d.t AS OF REVISION 1 WHERE row_id = :r LIMIT 1", {"r": i})
    assert old.rows == [{"count": 1}]
    assert code(session.execute, "SELECT count FROM d.t AS OF REVISION 1 LIMIT 1") == "validation_error"
    session.execute("RESTORE d.t ROW :r TO REVISION 1", {"r": i})
    assert session.execute("SELECT revision, count FROM d.t LIMIT 1").rows == [{"revision": 3, "count": 1}]
    first = session.execute("SHOW HISTORY FROM d.t FOR ROW :r LIMIT 2", {"r": i})
    rest = session.execute("SHOW HISTORY FROM d.t FOR ROW :r CURSOR :c LIMIT 2", {"r": i, "c": first.cursor})
    assert [r["operation"] for r in first.rows + rest.rows] == ["INSERT", "UPDATE", "COMPENSATE"] and rest.cursor is None
    session.execute("DELETE FROM d.t WHERE row_id = :r", {"r": i})
    assert code(session.execute, "SHOW HISTORY FROM d.t FOR ROW :r LIMIT 2", {"r": i}) == "not_found"
    assert session.execute("SELECT count FROM d.t AS OF COMMIT_SEQUENCE 3 LIMIT 5").rows == []


def test_split_merge_relations(session):
    a, b, c = (insert(session, title=t) for t in "abc")
    session.execute("RELATE d.t ROW :a TO d.t ROW :b TYPE 'cites'", {"a": a, "b": b})
    session.execute("RELATE d.t ROW :a TO d.t ROW :c TYPE 'cites'", {"a": a, "c": c})
    assert code(session.execute, "RELATE d.t ROW :a TO d.t ROW :b TYPE 'cites'", {"a": a, "b": b}) == "already_exists"
    assert session.execute("MERGE d.t ROWS (?, ?) INTO (title) VALUES ('bc')", [b, c]).affected == 3
    edges = session.execute("SHOW RELATIONS FROM d.t FOR ROW :a DIRECTION OUTGOING LIMIT 5", {"a": a}).rows
    assert len(edges) == 1
    new = edges[0]["target_row_id"]
    assert session.execute("SPLIT d.t ROW :r INTO (title) VALUES ('x'), ('y')", {"r": new}).affected == 3
    assert sorted(r["title"] for r in session.execute("SELECT title FROM d.t LIMIT 9").rows) == ["a", "x", "y"]
    session.execute("UNRELATE :i", {"i": edges[0]["relation_id"]})
    assert session.execute("SHOW RELATIONS FROM d.t FOR ROW :a DIRECTION OUTGOING LIMIT 5", {"a": a}).rows == []


def test_transactions(session, spark):
    done = session.batch(["BEGIN", "INSERT INTO d.t (title) VALUES ('x')", "SELECT title FROM d.t LIMIT 9", "INSERT INTO d.t (title) VALUES (NULL)", "COMMIT"])
    assert [r.status for r in done] == ["rolled_back", "rolled_back", "succeeded", "failed", "skipped"]
    assert done[2].rows == [{"title": "x"}]
    assert session.execute("SELECT title FROM d.t LIMIT 9").rows == []
    before = session.log.high_water()
    session.batch(["BEGIN", "INSERT INTO d.t (title) VALUES ('x')", "INSERT INTO d.t (title) VALUES ('y')", "COMMIT"])
    assert session.log.high_water() == before + 1
    changes = session.execute("SHOW CHANGES AFTER COMMIT_SEQUENCE :n LIMIT 5", {"n": before}).rows
    assert [c["entry_count"] for c in changes] == [2]
    assert len(session.execute("SHOW CHANGE :t LIMIT 5", {"t": changes[0]["transaction_id"]}).rows) == 2
    other = Session(spark, session.log.root)
    other.execute("INSERT INTO d.t (title) VALUES ('z')")
    assert code(session.log.commit, [{"kind": "row", "object_id": "r", "revision": 1}], before + 1) == "write_conflict"
    session.log.compact()
    assert sorted(r["title"] for r in Session(spark, session.log.root).execute("SELECT title FROM d.t LIMIT 9").rows) == ["x", "y", "z"]
    assert session.log.verify() == []


def test_catalog_and_routes(session):
    session.execute("ALTER TABLE d.t ADD COLUMN extra TEXT")
    session.execute("ALTER TABLE d.t RENAME COLUMN title TO heading")
    i = insert(session, title="alpha note", extra="beta")
    assert session.execute("SELECT TITLE FROM d.t LIMIT 1").rows == [{"heading": "alpha note"}]
    assert code(session.execute, "ARCHIVE COLUMN d.t.extra") == "validation_error"
    session.execute("ARCHIVE COLUMN d.t.extra REASON 'unused'")
    assert code(session.execute, "SELECT extra FROM d.t LIMIT 1") == "validation_error"
    assert len(session.execute("SHOW COLUMNS FROM d.t").rows) == 4 and len(session.execute("SHOW COLUMNS FROM d.t INCLUDING ARCHIVED").rows) == 5
    root = session.execute("CREATE ROUTE ROOT FOR TABLE d.t PURPOSE 'root'").rows[0]["route_id"]
    assert code(session.execute, "CREATE ROUTE ROOT FOR TABLE d.t PURPOSE 'root'") == "already_exists"
    leaf = session.execute("CREATE ROUTE UNDER :p NAME 'n1' KIND 'leaf' PURPOSE 'leaf'", {"p": root}).rows[0]["route_id"]
    session.place(leaf, ("d", "t"), i)
    assert session.execute("SELECT * FROM d.t LIMIT 1").rows[0]["route_paths"] == ["/n1"]
    assert [r["name"] for r in session.execute("SHOW ROUTES FROM TABLE d.t AT ROOT LIMIT 5").rows] == ["n1"]
    assert [r["row_id"] for r in session.execute("OPEN ROUTE :l LIMIT 1", {"l": leaf}).rows] == [i]
    assert code(session.execute, "DELETE ROUTE :l", {"l": leaf}) == "constraint_violation"
    found = session.execute("SHOW LEXICAL LOCATIONS FROM ALL TABLES USING 'Alpha note' LIMIT 5 BYTES 4096").rows
    assert found[0]["kind"] == "row" and found[0]["matched_term_count"] == 2
    assert session.execute("SHOW ROUTE CANDIDATES FROM ALL TABLES USING LEXICAL 'leaf' LIMIT 5 BYTES 4096").rows[0]["object_id"] == leaf
    assert code(session.execute, "SHOW LEXICAL LOCATIONS FROM ALL TABLES USING '--' LIMIT 5 BYTES 4096") == "validation_error"
    assert [r["kind"] for r in session.execute("SHOW CATALOG ATLAS COMPACT").rows] == ["database", "table"]
    session.execute("ALTER CONFIGURATION ROUTE_POLICY SET BRANCH_FANOUT 16")
    assert code(session.execute, "ALTER CONFIGURATION ROUTE_POLICY SET BRANCH_FANOUT 30") == "constraint_violation"
    assert session.execute("SHOW CONFIGURATION ROUTE_POLICY").rows[0]["branch_fanout"] == 16


def test_access(session, spark):
    insert(session, title="x")
    assert code(Session(spark, session.log.root, read_only=True).execute, "DELETE FROM d.t") == "permission_denied"
    assert code(Session(spark, session.log.root, databases=["other"]).execute, "SELECT title FROM d.t LIMIT 1") == "not_found"


def test_scope(session, spark):
    """A session of one database neither reads nor changes anything of another, by name or by id."""
    session.execute("CREATE DATABASE other PURPOSE 'x' SCOPE 'y'")
    root = session.execute("CREATE ROUTE ROOT FOR TABLE d.t PURPOSE 'root'").rows[0]["route_id"]
    leaf = session.execute("CREATE ROUTE UNDER :p NAME 'n1' KIND 'leaf' PURPOSE 'quokka'", {"p": root}).rows[0]["route_id"]
    a, b = insert(session, title="quokka"), insert(session, title="b")
    edge = session.execute("RELATE d.t ROW :a TO d.t ROW :b TYPE 'cites'", {"a": a, "b": b}).rows[0]["relation_id"]
    s = Session(spark, session.log.root, databases=["other"])
    for text, want in (("SHOW CHANGES LIMIT 5", "permission_denied"), ("SHOW CHANGES IN DATABASE d LIMIT 5", "not_found"), ("SHOW ROUTE TRACES LIMIT 5", "permission_denied"), ("SHOW TABLES FROM d", "not_found"), ("DESCRIBE TABLE d.t", "not_found"), ("RENAME", "parse_error")):
        assert code(s.execute, text) == want
    for text in ("DESCRIBE ROUTE :r", "SHOW ROUTES UNDER :r LIMIT 5", "OPEN ROUTE :r LIMIT 1", "DELETE ROUTE :r", "ALTER ROUTE :r RENAME TO 'x'", "CREATE ROUTE UNDER :r NAME 'n2' KIND 'leaf' PURPOSE 'x'"):
        assert code(s.execute, text, {"r": leaf if "OPEN" in text or "DELETE" in text else root}) == "not_found"
    assert code(s.execute, "UNRELATE :e", {"e": edge}) == "not_found"
    change = session.execute("SHOW CHANGES LIMIT 1").rows[0]["transaction_id"]
    assert code(s.execute, "SHOW CHANGE :t LIMIT 5", {"t": change}) == "permission_denied"
    assert [r["name"] for r in s.execute("SHOW DATABASES").rows] == ["other"] and s.execute("SHOW TABLES").rows == []
    assert s.execute("SHOW LEXICAL LOCATIONS FROM ALL TABLES USING 'quokka' LIMIT 5 BYTES 4096").rows == []
    assert [c["database_ids"] for c in s.execute("SHOW CHANGES IN DATABASE other LIMIT 5").rows] == [[s._database("other")["database_id"]]]


def test_levels(session, spark):
    own = lambda **k: Session(spark, session.log.root, **k)
    assert code(own(level="L0").execute, "INSERT INTO d.t (title) VALUES ('x')") == "permission_denied"
    assert own(level="L1").execute("INSERT INTO d.t (title) VALUES ('x')").affected == 1
    assert code(own(level="L1").execute, "CREATE DATABASE z PURPOSE 'x' SCOPE 'y'") == "permission_denied"
    assert code(own(level="L1").execute, "CREATE ROUTE ROOT FOR TABLE d.t PURPOSE 'r'") == "permission_denied"
    assert code(own(level="L0", levels={"D": "L1"}).execute, "ALTER TABLE d.t RENAME TO u") == "permission_denied"
    assert own(level="L0", levels={"D": "L1"}).execute("INSERT INTO d.t (title) VALUES ('y')").affected == 1
    assert own(level="L0").execute("SELECT title FROM d.t LIMIT 1").rows
    assert code(own, databases=["a"] * 33) == "validation_error" and code(own, level="L9") == "validation_error"
    strict = own(strict=True)
    assert code(strict.execute, "INSERT INTO d.t (title) VALUES ('x')") == "validation_error"
    assert strict.execute("INSERT INTO d.t (title) VALUES ('x')", expected_schema_version=1, max_affected_rows=1).affected == 1
    assert code(strict.execute, "INSERT INTO d.t (title) VALUES ('x')", expected_schema_version=1, max_affected_rows=0) == "constraint_violation"


def test_provenance(session):
    digest = "sha256:" + "a" * 64
    put = lambda **o: session.execute("INSERT INTO d.t (title) VALUES ('x')", **o)
    good = [{}, {"source_kind": "document_anchor", "source_locator": "p. 3", "source_content_hash": digest}, {"source_kind": "reviewed", "source_receipt_id": "r", "source_locator": "l", "source_content_hash": "b" * 64}]
    bad = [{"source_receipt_id": "r"}, {"source_kind": "document_anchor", "source_locator": "p. 3"}, {"source_kind": "repository_anchor", "source_locator": "l", "source_content_hash": "xyz"}, {"source_kind": "reviewed", "source_locator": "l", "source_content_hash": digest}, {"source_kind": "gossip"}]
    assert [put(**o).affected for o in good] == [1, 1, 1]
    assert [code(put, **o) for o in bad] == ["validation_error"] * 5
    assert session.log.read(session.seen)["source_receipt_id"] == "r"


def test_batch_text(session):
    from tesserae.language.parser import parse_batch

    text = "INSERT INTO d.t (title) VALUES ('a;b'); nonsense here; -- a comment; with one\nSELECT title FROM d.t LIMIT 5; /* ; */ ;"
    found = parse_batch(text)
    assert [getattr(x, "kind", None) or x.code for _, x in found] == ["insert", "parse_error", "select"]
    assert [r.status for r in session.batch(text)] == ["succeeded", "failed", "succeeded"]


def test_candidate_order(session):
    """Of equal scores a route comes before its table, and that before its database; BYTES cuts the list."""
    session.execute("CREATE DATABASE koala PURPOSE 'wombat' SCOPE 'all'")
    session.execute("CREATE TABLE koala.k (title TEXT) PURPOSE 'wombat' ROW SEMANTICS 'x'")
    root = session.execute("CREATE ROUTE ROOT FOR TABLE koala.k PURPOSE 'none'").rows[0]["route_id"]
    for n in "ab":
        session.execute("CREATE ROUTE UNDER :p NAME :n KIND 'leaf' PURPOSE 'wombat'", {"p": root, "n": n})
    get = lambda budget: session.execute("SHOW ROUTE CANDIDATES FROM ALL TABLES USING LEXICAL 'Wombat' LIMIT 9 BYTES :b", {"b": budget})
    rows = get(4096).rows
    assert [r["kind"] for r in rows] == ["route", "route", "table", "database"] and [r["object_id"] for r in rows[:2]] == sorted(r["object_id"] for r in rows[:2])
    short = get(400)
    assert 1 <= len(short.rows) < 4 and short.truncated


def test_locations_of_any_number(session, spark):
    """More locations than a page: cursors reach all of them, and a change ends them."""
    session.insert_many(("d", "t"), [{"title": f"numbat {k:03d}"} for k in range(150)])
    seen, cursor = [], None
    while True:
        text = "SHOW LEXICAL LOCATIONS FROM ALL TABLES USING 'numbat' " + ("CURSOR :c " if cursor else "") + "LIMIT 64 BYTES 65536"
        page = session.execute(text, {"c": cursor} if cursor else None)
        seen += [r["object_id"] for r in page.rows]
        if not page.cursor:
            break
        cursor = page.cursor
    assert len(seen) == len(set(seen)) == 150
    i = insert(session, title="numbat more")
    assert code(session.execute, text, {"c": cursor}) == "revision_conflict"
    session.execute("DELETE FROM d.t WHERE row_id = :r", {"r": i})
    assert session.execute("REBUILD LEXICAL INDEX").rows[0]["parity"]
    assert len(session.execute("SHOW LEXICAL LOCATIONS FROM ALL TABLES USING 'numbat 001' LIMIT 64 BYTES 65536").rows) == 64


def test_folded_reads(session, spark):
    """A read of one row after folding prunes folders by table and row groups by id."""
    i = insert(session, title="one")
    insert(session, title="two")
    session.log.compact()
    insert(session, title="three")
    s = Session(spark, session.log.root)
    plan = s.plan("SELECT title FROM d.t WHERE row_id = :r LIMIT 1", {"r": i})
    text = plan._jdf.queryExecution().toString()
    assert f"EqualTo(object_id,{i})" in text and "PartitionFilters: [isnotnull" in text and [r["title"] for r in plan.collect()] == ["one"]
    for k in range(9):
        insert(session, title=f"more {k}")
        session.log.compact()
    assert len(session.log._folded()[1]) < 9 and Session(spark, session.log.root).plan("SELECT title FROM d.t", bounded=False).count() == 12
    assert sorted(r["commit_sequence"] for r in session.log.commits().collect()) == list(range(1, session.log.high_water() + 1))


def test_window_of_gone_rows(session):
    """Rows that are deleted use up the scan's window."""
    session.execute("ALTER CONFIGURATION QUERY_BUDGETS SET ROUTE_CHILDREN 12, OPEN_LOCATORS 1, SELECT_SCAN 3, SELECT_ROWS 3, ROUTE_FRAME_NODES 12")
    ids = sorted(session.insert_many(("d", "t"), [{"title": f"r{k}"} for k in range(4)]))
    session.execute("DELETE FROM d.t WHERE row_id = :r", {"r": ids[0]})
    out = session.execute("SELECT row_id FROM d.t LIMIT 3")
    assert [r["row_id"] for r in out.rows] == ids[1:3] and out.truncated
    assert code(session.execute, "UPDATE d.t SET count = 1") in ("constraint_violation", "output_truncated")


def test_detail(session):
    i = insert(session, title="one", count=2)
    out = session.execute("SELECT count FROM d.t WHERE row_id = :r LIMIT 1", {"r": i})
    assert out.detail == {"database": "d", "table": "t", "display": "title", "roles": {"title": "title"}}
    assert session.execute("SELECT count FROM d.t LIMIT 1").detail is None
    got = session.key_range(("d", "t"), i, None, 5).collect()
    assert [r["row_id"] for r in got] == [i] and session.key_range(("d", "t"), None, None, 5, after=i).isEmpty()


def trace(k, database, steps=1, **more):
    step = lambda n: {"ordinal": n, "operation": "show_routes", "parent_route_id": None, "candidate_route_ids": ["a"], "selected_route_id": "a", "locators": [], "outcome": "selected", "elapsed_ms": n, "remaining_budget": 9 - n}
    return {"trace_id": f"trace_{k}", "recorded_at": "2024-01-01T00:00:00Z", "expires_at": f"2024-02-{k + 1:02d}T00:00:00Z", "actor": "a", "database_id": database, "table_id": "t", "status": "succeeded", "steps": [step(n + 1) for n in range(steps)]} | more


def test_route_traces(session):
    d = session._database("d")["database_id"]
    for k in range(5):
        assert session.record_trace(trace(k, d, steps=k + 1))["trace_sequence"] == k + 1
    assert session.record_trace(trace(2, d, steps=3))["trace_sequence"] == 3
    assert code(session.record_trace, trace(2, d, steps=2)) == "already_exists" and code(session.record_trace, trace(9, d, status="odd")) == "validation_error"
    page = session.execute("SHOW ROUTE TRACES IN DATABASE d AFTER TRACE_SEQUENCE 1 LIMIT 2")
    assert [r["trace_sequence"] for r in page.rows] == [2, 3] and page.rows[1]["step_count"] == 3
    rest = session.execute("SHOW ROUTE TRACES IN DATABASE d CURSOR :c LIMIT 5", {"c": page.cursor})
    assert [r["trace_sequence"] for r in rest.rows] == [4, 5]
    assert code(session.execute, "SHOW ROUTE TRACES CURSOR :c LIMIT 5", {"c": page.cursor}) == "validation_error"
    steps = session.execute("SHOW ROUTE TRACE 'trace_4' IN DATABASE d LIMIT 3")
    assert [r["ordinal"] for r in steps.rows] == [1, 2, 3] and steps.truncated
    assert session.prune_traces("2024-02-02T00:00:00Z") == 2
    assert code(session.execute, "SHOW ROUTE TRACES IN DATABASE d CURSOR :c LIMIT 5", {"c": page.cursor}) == "revision_conflict"
    assert [r["trace_id"] for r in session.execute("SHOW ROUTE TRACES LIMIT 9").rows] == ["trace_2", "trace_3", "trace_4"]
    assert code(session.execute, "SHOW ROUTE TRACE 'trace_0' LIMIT 3") == "not_found"


def test_route_mutations(session):
    root = session.execute("CREATE ROUTE ROOT FOR TABLE d.t PURPOSE 'root'").rows[0]["route_id"]
    new = lambda p, n, k: session.execute("CREATE ROUTE UNDER :p NAME :n KIND :k PURPOSE 'x'", {"p": p, "n": n, "k": k}).rows[0]["route_id"]
    b, c = new(root, "b", "branch"), new(root, "c", "branch")
    leaves = [new(b, f"l{k}", "leaf") for k in range(4)]
    row = insert(session, title="x")
    session.place(leaves[0], ("d", "t"), row)
    paths = lambda: sorted(r["path"] for r in session.catalog["route"].values() if r["_state"] == "live")

    def proposal(operation, sources, targets=(), **more):
        return {"id": f"p-{operation}", "actor": "a", "source_event_id": "e", "reason": "r", "operation": operation, "sources": [{"route_id": i, "expected_revision": session._route(i)["_revision"]} for i in sources], "targets": list(targets)} | more

    def run(p):
        plan = session.execute("PLAN ROUTE MUTATION FOR TABLE d.t USING :p", {"p": p}).rows[0]
        assert code(session.execute, "APPLY ROUTE MUTATION PLAN :p FOR TABLE d.t", {"p": plan}) == "permission_denied"
        return session.execute("APPLY ROUTE MUTATION PLAN :p FOR TABLE d.t", {"p": plan}, approved_hash=plan["plan_hash"]).affected

    target = lambda key, **more: {"key": key, "name": key, "purpose": "p"} | more
    for p in (proposal("SPLIT", [b], [target("x", child_route_ids=leaves[:2]), target("y", child_route_ids=leaves[2:3])]), proposal("MOVE", [root], target_parent_id=b), proposal("MOVE", [b], target_parent_id=leaves[0]), proposal("MERGE", [leaves[0], c], [target("m")]), proposal("SPLIT", [leaves[0]], [target("x"), target("y")]), proposal("SPLIT", [b], [target("c", child_route_ids=leaves), target("y")])):
        assert code(session.execute, "PLAN ROUTE MUTATION FOR TABLE d.t USING :p", {"p": p}) == "constraint_violation"
    stale = session.execute("PLAN ROUTE MUTATION FOR TABLE d.t USING :p", {"p": proposal("MOVE", [c], target_parent_id=b)}).rows[0]
    assert run(proposal("SPLIT", [b], [target("x", child_route_ids=leaves[:2]), target("y", child_route_ids=leaves[2:])])) == 7
    assert paths() == ["/", "/c", "/x", "/x/l0", "/x/l1", "/y", "/y/l2", "/y/l3"]
    assert code(session.execute, "APPLY ROUTE MUTATION PLAN :p FOR TABLE d.t", {"p": stale}, approved_hash=stale["plan_hash"]) == "not_found"
    x = next(r["route_id"] for r in session.catalog["route"].values() if r["path"] == "/x")
    y = next(r["route_id"] for r in session.catalog["route"].values() if r["path"] == "/y")
    assert run(proposal("MOVE", [y], target_parent_id=x)) == 1 and "/x/y/l3" in paths()
    assert code(session.execute, "PLAN ROUTE MUTATION FOR TABLE d.t USING :p", {"p": proposal("MOVE", [x], target_parent_id=y)}) == "constraint_violation"
    assert run(proposal("MERGE", leaves[:2], [target("both")])) == 4
    assert paths() == ["/", "/c", "/x", "/x/both", "/x/y", "/x/y/l2", "/x/y/l3"] and session.route_paths([row]) == {row: ["/x/both"]}


def test_exchange(session, spark, tmp_path):
    a, b = insert(session, title="first", count=1), insert(session, title="second")
    session.execute("RELATE d.t ROW :a TO d.t ROW :b TYPE 'cites'", {"a": a, "b": b})
    packed = session.execute("PACK DATABASE d BY 'me'", path=f"file://{tmp_path}/p1", key=b"k").rows[0]
    assert packed["signed"] and packed["rows"] == 9
    assert {r["kind"]: r["objects"] for r in session.execute("OPEN PACKAGE :p READ ONLY", {"p": packed["path"]}, key=b"k").rows} == {"column": 4, "database": 1, "relation": 1, "row": 2, "table": 1}
    other = Session(spark, f"file://{tmp_path}/other")
    assert code(Session(spark, other.log.root, level="L1").execute, "INSTALL PACKAGE :p TRUSTED", {"p": packed["path"]}) == "permission_denied"
    other.execute("INSTALL PACKAGE :p TRUSTED", {"p": packed["path"]}, key=b"k")
    assert code(other.execute, "INSTALL PACKAGE :p TRUSTED", {"p": packed["path"]}, key=b"k") == "already_exists"
    other.execute("UPDATE d.t SET count = 7 WHERE row_id = :a", {"a": a})
    session.execute("UPDATE d.t SET title = 'changed' WHERE row_id = :b", {"b": b})
    second = session.execute("PACK DATABASE d BY 'me'", path=f"file://{tmp_path}/p2", key=b"k").rows[0]

    from tesserae.store import packages

    assert packages.upgrade(other.log, packed["path"], second["path"], b"k") == {"merged": 1, "conflicts": []}
    assert sorted((r["title"], r["count"]) for r in Session(spark, other.log.root).execute("SELECT title, count FROM d.t LIMIT 5").rows) == [("changed", None), ("first", 7)]
    session.execute("UPDATE d.t SET count = 8 WHERE row_id = :a", {"a": a})
    third = session.execute("PACK DATABASE d BY 'me'", path=f"file://{tmp_path}/p3", key=b"k").rows[0]
    assert packages.merge(other.log, second["path"], third["path"], b"k")["conflicts"] == [f"row/{a}"]
    forked = packages.fork(other.log, packed["path"], f"file://{tmp_path}/fork", b"k", "you")
    assert forked["base"] == {"digest": packed["digest"], "author": "me"} and packages.open_package(spark, f"file://{tmp_path}/fork", b"k")[0]["author"] == "you"
    packages.revoke(other.log, third["digest"], "wrong")
    assert code(packages.upgrade, other.log, second["path"], third["path"], b"k") == "permission_denied"
    wiki = session.execute("EXPORT WIKI TO :p PROFILE 'full'", {"p": f"file://{tmp_path}/wiki"}).rows[0]
    assert wiki == {"pages": 2, "written": 2, "removed": 0} and "out cites" in (tmp_path / "wiki" / f"p-{a.replace('_', '_5F_')}.md").read_text()
    assert code(session.execute, "EXPORT WIKI TO 'x' PROFILE 'odd'") == "validation_error"


def test_submissions(session):
    plan = {"submission_id": "s1", "statements": [["INSERT INTO d.t (title, count) VALUES (:t, :n)", {"t": "from 1999", "n": 3}]], "evidence": ["in 1999 there were 3"]}
    review = session.execute("REVIEW ASSIMILATION FOR DATABASE d USING :p", {"p": plan}).rows[0]
    assert review["unsupported_numbers"] == [] and review["statements"] == 1
    submit = lambda p, **o: session.execute("SUBMIT ASSIMILATION PLAN :p FOR DATABASE d", {"p": p}, **o)
    assert code(submit, plan) == "permission_denied"
    first = submit(plan, approved_hash=review["plan_hash"]).rows[0]
    assert submit(plan).rows[0] == first and session.execute("SHOW ASSIMILATION RECEIPT 's1' IN DATABASE d").rows[0] == first
    assert [r["title"] for r in session.execute("SELECT title FROM d.t LIMIT 5").rows] == ["from 1999"]
    assert code(submit, plan | {"evidence": []}) == "already_exists"
    bare = plan | {"submission_id": "s2", "evidence": []}
    found = session.execute("REVIEW ASSIMILATION FOR DATABASE d USING :p", {"p": bare}).rows[0]
    assert found["unsupported_numbers"] == ["1999", "3"] and code(submit, bare, approved_hash=found["plan_hash"]) == "constraint_violation"
    broken = plan | {"submission_id": "s3", "statements": [*plan["statements"], ["INSERT INTO d.t (title) VALUES (NULL)", None]]}
    assert code(submit, broken, approved_hash=session.execute("REVIEW ASSIMILATION FOR DATABASE d USING :p", {"p": broken}).rows[0]["plan_hash"]) == "constraint_violation"
    assert len(session.execute("SELECT title FROM d.t LIMIT 5").rows) == 1


def test_bootstrap(session):
    root = session.execute("CREATE ROUTE ROOT FOR TABLE d.t PURPOSE 'root'").rows[0]["route_id"]
    session.execute("CREATE ROUTE UNDER :p NAME 'n1' KIND 'leaf' PURPOSE 'bilby'", {"p": root})
    parts = [r["part"] for r in session.bootstrap("bilby")]
    assert parts == ["atlas", "atlas", "location", "route"]
    assert [r["part"] for r in session.bootstrap("bilby", 600)] == ["atlas", "atlas"] and [r["part"] for r in session.bootstrap("--")] == ["atlas", "atlas", "route"]


def test_audit_and_contents(session, spark):
    from tesserae.store.audit import Audit
    from tesserae.store.contents import Contents

    audit = Audit(spark, session.log.root)
    for k in range(3):
        audit.append("me", "open", f"object {k} é", "done")
    assert [r["sequence"] for r in audit.scan(after=1).collect()] == [2, 3] and audit.verify() == []
    entry = audit.files.read_json(f"{2:020d}.json") | {"outcome": "denied"}
    audit.files.delete(f"{2:020d}.json")
    import json

    audit.files.publish(f"{2:020d}.json", json.dumps(entry).encode())
    assert audit.verify() == [2]
    held = Contents(spark, session.log.root, most_bytes=100, most_total=150)
    digest = held.put(b"x" * 90, "a")
    assert held.open(digest) == b"x" * 90 and held.put(b"y" * 20, "b") and code(held.put, b"z" * 101, "a") == "constraint_violation" and code(held.put, b"z" * 60, "a") == "constraint_violation"
    assert held.release(digest, "other") is False and held.release(digest, "a") is True and code(held.open, digest) == "not_found"


def test_two_writers(session, spark):
    """A commit that loses against another one leaves nothing behind, and its session goes on from what is there."""
    other = Session(spark, session.log.root)
    other.execute("SELECT title FROM d.t LIMIT 1")
    session.execute("BEGIN")
    session.execute("INSERT INTO d.t (title) VALUES ('mine')")
    other.execute("INSERT INTO d.t (title) VALUES ('theirs')")
    assert code(session.execute, "COMMIT") == "write_conflict"
    assert [r["title"] for r in session.execute("SELECT title FROM d.t LIMIT 5").rows] == ["theirs"]
    assert session.log.files.names("_commits") == [f"{k:020d}.json" for k in range(1, session.log.high_water() + 1)]


def test_schema_plan(session):
    insert(session, title="a long title", count=1)
    changes = [{"op": "add", "name": "extra", "type": "TEXT"}, {"op": "rename", "column": "count", "to": "n"}, {"op": "alter", "column": "done", "nullable": False}]
    plan = session.execute("PLAN SCHEMA CHANGE FOR TABLE d.t USING :c", {"c": changes}).rows[0]
    assert plan["blockers"] == [{"change": 2, "reason": "1 rows are null"}]
    plan = session.execute("PLAN SCHEMA CHANGE FOR TABLE d.t USING :c", {"c": changes[:2]}).rows[0]
    assert plan["blockers"] == []
    assert code(session.execute, "APPLY SCHEMA CHANGE PLAN :p FOR TABLE d.t", {"p": plan}) == "permission_denied"
    session.execute("APPLY SCHEMA CHANGE PLAN :p FOR TABLE d.t", {"p": plan}, approved_hash=plan["plan_hash"])
    assert session.execute("SELECT n, extra FROM d.t LIMIT 1").rows == [{"n": 1, "extra": None}]
    assert code(session.execute, "APPLY SCHEMA CHANGE PLAN :p FOR TABLE d.t", {"p": plan}, approved_hash=plan["plan_hash"]) == "revision_conflict"


def test_vectors(session):
    root = session.execute("CREATE ROUTE ROOT FOR TABLE d.t PURPOSE 'root'").rows[0]["route_id"]
    a, b = (session.execute("CREATE ROUTE UNDER :p NAME :n KIND 'branch' PURPOSE 'x'", {"p": root, "n": n}).rows[0]["route_id"] for n in "ab")
    assert session.publish_vectors("s", {a: [1.0, 0.0], b: [0.6, 0.8]}, {"model": "m"}) == 1
    find = lambda: [(r["route_id"], round(r["score"], 6)) for r in session.execute("SHOW ROUTE CANDIDATES FROM ALL TABLES USING VECTOR :q SPACE 's' LIMIT 5 BYTES 4096", {"q": [0.0, 1.0]}).rows]
    assert find() == [(b, 0.8), (a, 0.0)]
    session.execute("ALTER ROUTE :r SET SYNOPSIS 'changed'", {"r": b})
    assert find() == [(a, 0.0)]  # the vector of a changed route is stale
    with pytest.raises(StatementError):
        session.publish_vectors("s", {a: [2.0, 0.0]}, {})


def test_packages(session, spark, tmp_path):
    from tesserae.store import packages
    from tesserae.store.log import CommitLog

    i = insert(session, title="kept", count=3)
    session.execute("DELETE FROM d.t WHERE row_id = :r", {"r": insert(session, title="gone")})
    path, database = f"file://{tmp_path}/p", session._database("d")["database_id"]
    packages.pack(session.log, database, path, b"key")
    other = CommitLog(spark, f"file://{tmp_path}/other")
    assert code(packages.install, other, path, b"wrong") == "permission_denied"
    packages.install(other, path, b"key")
    assert code(packages.install, other, path) == "already_exists"
    assert Session(spark, other.root).execute("SELECT row_id, title, count FROM d.t LIMIT 5").rows == [{"row_id": i, "title": "kept", "count": 3}]
