"""A project's life: index, search, walk, remember, edit, rename, verify, watch."""

import subprocess

import pytest

from corpusgraph.session import AmbiguousError, Project

AUTH = '''"""Auth."""
from src.util import helper


def load_key():
    return helper()


class TokenStore:
    def refresh(self):
        return load_key()


def verify_token(t):
    return TokenStore().refresh() and load_key()
'''


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "src").mkdir()
    (root / "tests").mkdir()
    (root / "src/auth.py").write_text(AUTH)
    (root / "src/util.py").write_text("def helper():\n    return 1\n")
    (root / "tests/test_auth.py").write_text("from src.auth import verify_token\n\n\ndef test_verify_token():\n    assert verify_token(1)\n")
    (root / "README.md").write_text("# Demo\n\nTokens and keys.\n")
    (root / "prod.env").write_text("API_KEY=q7Jx9Lm2Vb8Rt5Zp0Wn4Kd6Hs3Yc1Gf\n")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    p = Project(spark, str(root))
    p.init()
    p.stats = p.index()
    return p, root


def test_index_is_incremental(project):
    p, root = project
    assert p.stats["gated"] == 1 and p.stats["nodes"] > 8
    again = p.index()
    assert again["changed"] == 0 and again["nodes"] == p.index()["nodes"]
    for f in root.rglob("*.parquet"):
        assert b"q7Jx9Lm2Vb8Rt5Zp" not in f.read_bytes()


def test_search_puts_the_exact_hit_first(project):
    p, _ = project
    out = p.search("verify_token")
    assert out["items"][0]["location"] == "src/auth.py::verify_token" and out["items"][0]["provenance"]["via"] == "exact"
    assert p.search('" OR NOT * (')["mode"] == "fts+graph" and p.search("你好")["items"] == []
    with pytest.raises(ValueError):
        p.search("")


def test_evaluation(project, tmp_path):
    p, _ = project
    (tmp_path / "cases.json").write_text('{"cases": [{"query": "verify_token", "expected": ["src/auth.py::verify_token"]}, {"query": "load_key", "expected": ["src/auth.py::load_key", "nowhere.py::x"]}]}')
    out = p.evaluate(str(tmp_path / "cases.json"))
    assert out["recall"] == 0.75 and out["median_ms"] > 0


def test_walks(project):
    p, _ = project
    hit = {i["location"] for i in p.impact("load_key", depth=3)["items"]}
    assert {"src/auth.py::verify_token", "src/auth.py::TokenStore.refresh"} <= hit
    tests = p.impact("verify_token", tests_only=True)["items"]
    assert [i["kind"] for i in tests] == ["test"]
    called = {i["location"] for i in p.neighbors("verify_token", edge="calls")["items"]}
    assert called == {"src/auth.py::load_key", "src/auth.py::TokenStore", "src/auth.py::TokenStore.refresh"}
    assert any(i["location"] == "src/util.py" for i in p.neighbors("src/auth.py", edge="imports")["items"])
    assert p.map().count() == 3 and p.show("load_key")["callees"] == "helper"
    with pytest.raises(LookupError):
        p.resolve("nothing_here")


def test_memory_follows_and_goes_stale(project):
    p, root = project
    m = p.remember("decision", "Refresh tokens lazily.", anchor="src/util.py::helper")
    assert p.recall(m)["state"] == "fresh" and p.why("tokens")["items"][0]["id"] == m
    assert p.verify()["drifted"] == 0
    p.pin(m)
    assert p.recall(m)["pinned"]
    handle = p.create_context("tokens", (m, "src/auth.py::load_key"))
    assert [i["id"] for i in p.load_context(handle, budget=20_000)["items"]][0] == m
    with pytest.raises(PermissionError):
        p.remember("decision", "api_key = q7Jx9Lm2Vb8Rt5Zp0Wn4Kd6Hs3Yc1Gf")
    (root / "src/util.py").write_text("def helper():\n    return 2\n")
    assert p.verify()["drifted"] >= 2
    p.index()
    assert p.recall(m)["state"] == "stale"


def test_embeddings_are_cached(project):
    p, _ = project
    first, second = p.embed(), p.embed()
    assert first["embedded"] > 0 and second["embedded"] == 0
    assert p.search("token refresh", semantic=True)["mode"] == "semantic+fts+graph"


def test_ambiguity(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"m{i}.py").write_text("def common():\n    pass\n")
    p = Project(spark, str(tmp_path))
    p.index()
    with pytest.raises(AmbiguousError):
        p.resolve("common")
    assert p.resolve("m1.py::common")["path"] == "m1.py"
    (tmp_path / "m0.py").write_text("def renamed():\n    pass\n")
    (tmp_path / "m1.py").unlink()
    assert p.index()["removed"] == 1
    # An incremental index equals a full one.
    cols = ["src", "dst", "kind", "weight"]
    part = sorted(map(tuple, p.store.read("edges").select(cols).collect()))
    p.index(full=True)
    assert sorted(map(tuple, p.store.read("edges").select(cols).collect())) == part


def test_watch(spark, tmp_path):
    (tmp_path / "a.py").write_text("def a():\n    pass\n")
    p = Project(spark, str(tmp_path))
    q = p.watch(str(tmp_path / ".corpusgraph/stream"), every=None)
    q.awaitTermination(120)
    assert q.exception() is None and p.resolve("a.py::a")["kind"] == "symbol"


def test_state_is_that_of_the_file_as_it_is_now(spark, tmp_path):
    (tmp_path / "a.py").write_text("def alpha():\n    return 1\n\n\ndef beta():\n    return 2\n")
    (tmp_path / "b.py").write_text("def gamma():\n    return 3\n")
    p = Project(spark, str(tmp_path))
    p.index()
    assert p.expand("alpha")["items"][0]["state"] == "fresh"
    (tmp_path / "a.py").write_text("def beta():\n    return 2\n\n\ndef alpha():\n    return 10\n")
    shown = p.expand("alpha")["items"][0]
    assert shown["state"] == "stale" and "return 10" in shown["content"] and shown["warning"]
    assert p.expand("beta")["items"][0]["state"] == "fresh"
    with pytest.raises(ValueError):
        p.remember("decision", "Keep it.", anchor="a.py::alpha")
    m = p.remember("decision", "Keep beta.", anchor="a.py::beta")
    assert [r.dst[:5] for r in p.derived_from().filter(f"src = '{m}'").collect()] == ["epis_"]
    (tmp_path / "a.py").write_text("def alpha():\n    token = 'q7Jx9Lm2Vb8Rt5Zp0Wn4Kd6Hs3Yc1Gf'\n")
    with pytest.raises(PermissionError):
        p.expand("alpha")
    assert all(i["location"].startswith("b.py") for i in p.search("alpha gamma")["items"])
    (tmp_path / "b.py").unlink()
    gone = p.expand("gamma")["items"][0]
    assert gone["state"] == "stale" and gone["content"] == ""
    # What the gate refuses now is in no table once it is indexed again.
    p.index()
    assert not any(b"return 10" in f.read_bytes() or b"q7Jx9Lm2" in f.read_bytes() for f in tmp_path.rglob("*.parquet"))


def test_watch_sees_deletions(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for n in "ab":
        (root / f"{n}.py").write_text(f"def {n}():\n    pass\n")
    p = Project(spark, str(root))
    for gone in (None, "b.py", None):
        if gone:
            (root / gone).unlink()
        q = p.watch(str(tmp_path / "stream"), every=None)
        q.awaitTermination(120)
        assert q.exception() is None
    assert p.store.read("files").count() == 1
    # A folder that hasn't changed starts no batch.
    assert p.store.state["version"] == 2
