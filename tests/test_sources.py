import os
import re
import shutil
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from trellis.operators import graph, lookup
from trellis import errors
from trellis.sources import adapters, repo
from trellis.sources.extract import braces, python
from trellis.streaming import upsert

PY = '''import os
from .util import helper as h

LIMIT = 3

class Base:
    pass

class Job(Base):
    def run(self):
        return h(self.step())

    def step(self):
        return os.getcwd()

def main():
    Job().run()
'''
RUST = '''use crate::util::helper;
use crate::other::thing as alias;
pub const MAX: u32 = 3;
pub struct Launcher { n: u32 }
trait Runnable { fn go(&self); }
impl Runnable for Launcher {
    fn go(&self) { start_engine(1); helper("fn not_me() {"); /* fn nor_me() {} */ }
}
pub fn start_engine(n: u32) -> u32 {
    crate::util::deep(n)
}
'''
TS = '''import { helper as h, other } from "./util";
export interface Shape { area(): number; }
export class Box implements Shape {
  area(): number { return h(this.side()); }
  side(): number { return other(2); }
}
export const twice = (n: number) => other(n) * 2;
export function main() { twice(3); }
'''
GO = '''package main

import (
	util "./util"
	_ "fmt"
)

type Speaker interface { Speak() string }
type Alias = Speaker
type Dog struct { name string }

const Limit = 3

func (d *Dog) Speak() string { return util.Helper(d.name) }

func main() { run() }
'''


def kinds(unit):
    return {(s.symbol, s.kind) for s in unit.symbols}


def test_python():
    u = python.extract("src/pkg/job.py", PY)
    assert kinds(u) == {("os", "import"), ("h", "import"), ("LIMIT", "const"), ("Base", "class"), ("Job", "class"), ("run", "method"), ("step", "method"), ("main", "function")}
    e = {(a, b, k) for a, b, k, _ in u.edges}
    assert {("Job", "run", "contains"), ("run", "helper", "calls"), ("run", "step", "calls"), ("Job", "Base", "implements"), ("h", "helper", "imports"), ("main", "run", "calls")} <= e
    assert ("src/pkg/util.py", "src/pkg/util/__init__.py") in {w for *_, w in u.edges}
    assert python.extract("a.py", "def (") == python.Unit()


def test_rust():
    u = braces.rust("src/main.rs", RUST)
    assert kinds(u) == {("helper", "import"), ("alias", "import"), ("MAX", "const"), ("Launcher", "struct"), ("Runnable", "trait"), ("go", "function"), ("start_engine", "function")}
    e = {(a, b, k) for a, b, k, _ in u.edges}
    assert {("Launcher", "Runnable", "implements"), ("Launcher", "go", "contains"), ("go", "start_engine", "calls"), ("go", "helper", "calls"), ("start_engine", "deep", "calls"), ("alias", "thing", "imports")} <= e
    assert {r[2] for r in u.references} >= {"start_engine", "helper", "crate", "util", "deep"}
    f = next(s for s in u.symbols if s.symbol == "start_engine")
    assert (f.start_line, f.end_line, f.signature) == (9, 11, "pub fn start_engine(n: u32) -> u32")


def test_typescript():
    u = braces.typescript("web/box.ts", TS)
    assert kinds(u) >= {("Shape", "interface"), ("Box", "class"), ("area", "method"), ("side", "method"), ("twice", "variable"), ("main", "function"), ("h", "import"), ("other", "import")}
    e = {(a, b, k) for a, b, k, _ in u.edges}
    assert {("Box", "Shape", "implements"), ("Box", "area", "contains"), ("area", "helper", "calls"), ("area", "side", "calls"), ("main", "twice", "calls"), ("twice", "other", "calls")} <= e


def test_go():
    u = braces.go("svc/main.go", GO)
    assert kinds(u) >= {("Speaker", "interface"), ("Alias", "type_alias"), ("Dog", "struct"), ("Limit", "const"), ("Speak", "method"), ("main", "function"), ("util", "import")}
    assert not {s.symbol for s in u.symbols} & {"fmt", "_"}
    e = {(a, b, k) for a, b, k, _ in u.edges}
    assert {("Dog", "Speak", "contains"), ("Speak", "Helper", "calls"), ("main", "run", "calls")} <= e


@pytest.fixture
def tree(tmp_path):
    files = {"src/pkg/job.py": PY, "src/pkg/util.py": "def helper(x):\n    return x\n", "src/pkg/__init__.py": "", "src/main.rs": RUST, "src/util.rs": "pub fn helper(s: &str) {}\npub fn deep(n: u32) -> u32 { n }\n", ".hidden/x.py": "a = 1", "skip/y.py": "b = 1", ".gitignore": "skip/\n*.log\n", "a.log": "x", "bin.dat": b"\xff\xfe\x00"}
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t if isinstance(t, bytes) else t.encode())
    return tmp_path


def test_index_of_a_tree(spark, tree):
    files = repo.scan(spark, str(tree)).cache()
    assert {r.file_path: r.line_count for r in files.collect()} == {"bin.dat": 0, "src/main.rs": 11, "src/pkg/__init__.py": 0, "src/pkg/job.py": 17, "src/pkg/util.py": 2, "src/util.rs": 2}
    ix = repo.build(files)
    ids = sorted((r.symbol_id, r.file_path, r.start_line) for r in ix.symbols.collect())
    assert [i for i, *_ in ids] == list(range(1, len(ids) + 1)) and [x[1:] for x in ids] == sorted(x[1:] for x in ids)
    assert {(r.symbol, r.file_path) for r in graph.callers(ix, "helper").collect()} == {("run", "src/pkg/job.py"), ("go", "src/main.rs")}
    assert lookup.find(ix, "deep").first().confidence == "ast_exact"
    repo.save(ix, str(tree / ".index"))
    back = repo.load(spark, str(tree / ".index"))
    assert back.edges.count() == ix.edges.count()
    # a second build after an edit keeps ids
    (tree / "src/util.rs").write_text("// first\npub fn helper(s: &str) {}\npub fn fresh() {}\n")
    again = repo.build(repo.scan(spark, str(tree)), back)
    old, new = ({(r.file_path, r.symbol, r.kind): r.symbol_id for r in x.symbols.collect()} for x in (back, again))
    assert all(new[k] == v for k, v in old.items() if k in new) and new["src/util.rs", "fresh", "function"] == len(ids) + 1
    assert repo.freshness(files, 0.0, None, None) == "stale" and repo.freshness(files, 1e12, "a", "a") == "fresh"
    with pytest.raises(errors.StaleIndex):
        repo.freshness(files, 1e12, "a", "b", require=True)


def test_git_sources(spark, tree):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    first = repo.head(str(tree))
    os.remove(tree / "src/util.rs")
    (tree / "src/pkg/test_job.py").write_text("x = 1\n")
    git("add", "-A")
    git("commit", "-qm", "two")
    assert repo.changed_files(str(tree), since=first, named=["./z.py"]) == ["src/pkg/test_job.py", "src/util.rs", "z.py"]
    got = {(r.file_path, r.status, r.is_test) for r in repo.verify_refactor(spark, str(tree), first, "HEAD").collect()}
    assert got == {("src/util.rs", "D", False), ("src/pkg/test_job.py", "A", True)}
    with pytest.raises(errors.PartialData, match="2 changed file"):
        repo.verify_refactor(spark, str(tree), first, "HEAD", strict=True)
    with pytest.raises(errors.PartialData, match="not provided"):
        repo.verify_refactor(spark, str(tree), first, strict=True)
    assert repo.verify_refactor(spark, str(tree), "nosuch", "HEAD").count() == 0


def test_named_files_are_relative(tmp_path):
    root = str(tmp_path)
    assert [repo.relative(root, x) for x in ("./a/b.rs", ".\\c.rs", f"{root}/d.rs", "/elsewhere/e.rs")] == ["a/b.rs", ".\\c.rs".replace("\\", "/"), "d.rs", "/elsewhere/e.rs"]


def test_an_index_is_made_anew_when_stale(spark, tree, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "ix")
    first = repo.index(spark, str(tree), path).first()
    assert first.indexed_files == 6 and first.unchanged_files == 0
    again = repo.index(spark, str(tree), path).first()
    assert again.indexed_files == 0 and again.unchanged_files == 6
    later = again.indexed_at + 100
    (tree / "src/util.rs").write_text("pub fn brand_new() {}\n")
    os.utime(tree / "src/util.rs", (later, later))
    assert repo.ensure(spark, str(tree), path).symbols.where("symbol = 'brand_new'").count() == 0
    with pytest.raises(errors.StaleIndex):
        repo.ensure(spark, str(tree), path, require_fresh=True)
    assert repo.ensure(spark, str(tree), path, auto_index=True).symbols.where("symbol = 'brand_new'").count() == 1


def test_stored_snapshots_follow_their_input(spark, tmp_path):
    from trellis.sources import snapshot

    sf = str(tmp_path)
    spark.createDataFrame([(1, "alpha beta\nalpha", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{sf}/documents.parquet")
    first = adapters.corpus(spark, sf)
    assert first is adapters.corpus(spark, sf) and first.names.count() == 2
    spark.createDataFrame([(1, "gamma", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars int").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert [r.symbol for r in adapters.corpus(spark, sf).names.collect()] == ["gamma"]
    assert snapshot.fingerprint(spark, sf, ("documents",)) != snapshot.fingerprint(spark, "/root/testdata/sf0.001", ("documents",))


def test_stream_of_changes(spark, tmp_path):
    src, state = tmp_path / "in", {"table": spark.createDataFrame([("a", 1, "old"), ("b", 1, "keep")], "file_path string, version int, text string")}
    schema = "file_path string, version int, text string"
    spark.createDataFrame([("a", 2, "new"), ("a", 3, "newest"), ("c", 1, "add")], schema).write.parquet(str(src))

    def apply(df, n):
        state["table"] = spark.createDataFrame(upsert.merge(state["table"], df).collect(), schema)

    upsert.follow(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "ck"), apply).awaitTermination(60)
    assert {(r.file_path, r.text) for r in state["table"].collect()} == {("a", "newest"), ("b", "keep"), ("c", "add")}


def test_scan_of_texts(spark):
    from trellis.sources import scan

    texts = ["", None, "alpha\n", "end", "next 3x é _y\r\n\n  two_words, zwei\nalpha 9 beta alpha\n\n", "ß\n" * 3 + "x" * 70, "a b\nb a\nc\nb c a"] * 3
    files = spark.createDataFrame([(i, f"f{i}", "rust", t) for i, t in enumerate(texts)], "doc_id long, file_path string, language string, text string").coalesce(1)
    tokens, defined, used = [], [], set()
    for i, t in enumerate(texts):
        parts = (t or "").split("\n")
        lines = {n: [(m[0].decode(), m.start() + 1) for m in re.finditer(rb"[A-Za-z0-9_]+", x.encode()) if not m[0][:1].isdigit()] for n, x in enumerate(parts, 1)}
        heads = {n: x[0] for n, x in lines.items() if x}
        count = len(parts) - (parts[-1] == "")
        tokens += [(f"f{i}", s, n, c, k > 0) for n, x in lines.items() for k, (s, c) in enumerate(x)]
        defined += [(i, s, n, c, min([m for m in heads if m > n], default=count + 1) - 1) for n, (s, c) in heads.items()]
        for n, x in lines.items():
            for s, _ in x[1:]:
                to = min((m % 5 == 4, m) for m, h in heads.items() if h[0] == s)[1] if any(h[0] == s for h in heads.values()) else None
                used |= {(i, s, n, to)} if to != n else set()
    got = [tuple(r) for r in scan.tokens(files).collect()]
    assert sorted(got) == sorted(tokens) and got == sorted(got, key=lambda r: (r[1], r[0], r[2], r[3]))
    assert sorted(tuple(r) for r in scan.definitions(files).select("doc_id", "symbol", "start_line", "start_column", "end_line").collect()) == sorted(defined)
    found = [tuple(r) for r in scan.uses(files).select("doc_id", "symbol", "line", "to_line").collect()]
    assert len(found) == len(used) and set(found) == used


def test_snapshot_of_documents_holds_neither_texts_nor_references_again(spark, tmp_path):
    from trellis.operators import lookup
    from trellis.sources import snapshot

    sf, place = str(tmp_path), str(tmp_path / "index")
    spark.createDataFrame([(i, "alpha beta gamma\nbeta alpha alpha", "en", "s", 1) for i in range(1, 30)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{sf}/documents.parquet")
    ix = snapshot.build(spark, sf, "corpus", adapters.CORPUS_TABLES, adapters.corpus_index, place)
    assert not (tmp_path / "index/references").exists() and "text" not in ix.files.columns
    assert ix.tokens.count() == 6 * 29 and ix.references.count() == 3 * 29 and ix.tokens.columns == ix.references.columns
    assert [r.snippet for r in lookup.snippets(adapters.corpus(spark, sf), "beta").collect()] == ["beta alpha alpha"] * 29


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    from trellis import workdir

    def kept():
        return {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}

    before = kept()
    workdir.write(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count(), str(tmp_path / "groups"))
    for _ in range(50):  # they go in the background
        if not (left := kept() - before):
            break
        time.sleep(0.2)
    assert not left and spark.read.parquet(str(tmp_path / "groups")).count() == 100


def written(spark):
    """Bytes that shuffles have written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).head().totalShuffleWrite()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A copy of the documents, its size, and what was shuffled to store their snapshot."""
    sf = tmp_path_factory.mktemp("documents")
    shutil.copy("/root/testdata/sf0.01/documents.parquet", sf)
    before = written(spark)
    adapters.corpus(spark, str(sf))
    return str(sf), (sf / "documents.parquet").stat().st_size, written(spark) - before


@pytest.mark.parametrize("name", ["circular_corpus", "context_full", "dead_aggressive", "refs_text_fallback", "dead_conservative", "explain_snippet", "move_check", "context_direct"])
def test_queries_of_documents_shuffle_less_than_their_budget_of_disk(spark, stored, name):
    from trellis.plans.queries import queries

    sf, size, snapshot = stored
    before = written(spark)
    assert queries()[name](spark, sf).collect()
    assert snapshot + written(spark) - before < 4 * size
