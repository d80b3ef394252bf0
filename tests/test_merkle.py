"""Merkle trees and nested trees against plain recursion."""

import hashlib
import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import merkle

_KIND = "path string, content string, size_bytes long"


def frame(spark, files):
    return spark.createDataFrame([(p, c, len(c or "")) for p, c in files.items()], _KIND)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digests(files):
    """{directory: (digest, files below)} by recursion."""
    out = {}

    def walk(directory):
        below, entries, n = defaultdict(dict), {}, 0
        for p, c in files.items():
            if directory and not p.startswith(directory + "/"):
                continue
            rest = p[len(directory) + 1 if directory else 0 :]
            if "/" in rest:
                below[rest.split("/")[0]][p] = c
            else:
                entries[rest] = ("f", sha(c or ""))
                n += 1
        for name in below:
            digest, m = walk(f"{directory}/{name}" if directory else name)
            entries[name] = ("d", digest)
            n += m
        blocks = defaultdict(str)
        for name, (kind, digest) in sorted(entries.items(), key=lambda x: x[0].encode()):
            blocks[sha(name)[:3]] += f"{name}\0{kind}\0{digest}\n"
        out[directory] = (sha("".join(b + sha(x) for b, x in sorted(blocks.items()))), n)
        return out[directory]

    walk("")
    return out


@pytest.fixture
def files():
    return {"top.py": "1", "a/b/c/d/deep.py": "2", "a/b/x.py": "3", "a/é.py": None, "z/only.py": "5", **{f"many/f{k}.py": str(k) for k in range(300)}, "many/sub/s.py": "9"}


def test_digests(spark, files):
    directories, blocks, children = merkle.fold(frame(spark, files))
    assert {r.directory: (r.digest, r.file_count) for r in directories.collect()} == plain_digests(files)
    assert children.count() == len(files) + len(plain_digests(files)) - 1 and blocks.where("directory = 'many'").count() > 200
    empty = merkle.fold(frame(spark, files).limit(0))[0].collect()
    assert [(r.directory, r.digest, r.file_count) for r in empty] == [("", sha(""), 0)]


def test_difference_reads_what_differs(spark, files, tmp_path, monkeypatch):
    read = []
    real = merkle.Tree.of
    monkeypatch.setattr(merkle.Tree, "of", lambda self, name, wanted, *by: (read.extend((name, *(r[k] for k in by)) for r in wanted.select(*by).collect()), real(self, name, wanted, *by))[1])
    tree = lambda name, own: merkle.Tree(spark, str(tmp_path / name), 16).write(frame(spark, own))
    before = tree("a", files)
    assert merkle.diff(before, tree("same", files)).count() == 0 and not read
    after = dict(files)
    after["many/f7.py"] = "other"
    del after["z/only.py"]
    after["z"] = "now a file"
    after["new/dir/n.py"] = "n"
    got = {(r.path, r.change) for r in merkle.diff(before, tree("b", after)).collect()}
    assert got == {("many/f7.py", "changed"), ("z/only.py", "deleted"), ("z", "new"), ("new/dir/n.py", "new")}
    directories = {x[1] for x in read}
    assert directories == {"", "many", "z", "new", "new/dir"}  # nothing below a/
    assert len({x for x in read if x[:2] == ("children", "many")}) == 1  # one block of three hundred files
    assert before.read("children", [3]).select("name").count() < 60 and "PartitionFilters: []" not in before.read("children", [3])._jdf.queryExecution().toString()


def plain_tree(paths, prefix="", language=lambda p: {"py": "python", "ts": "typescript"}.get(p.rsplit(".", 1)[-1])):
    root = {}
    for p in sorted(paths):
        parts = [x for x in p[len(prefix) :].lstrip("/").split("/") if x]
        at = root
        for x in parts[:-1]:
            if not isinstance(at.get(x), dict) or "type" in at[x]:
                at[x] = {}
            at = at[x]
        at[parts[-1]] = {"path": p, "type": "file", "language": language(p), "symbol_count": 0}
    def listed(node):
        return [v if "type" in v else {"path": k + "/", "type": "dir", "children": listed(v)} for k, v in sorted(node.items())]
    return listed(root)


def test_nested_trees(spark, files, monkeypatch):
    """Equal to a plain builder; a folder of very many children is dealt over tasks and put together from many runs."""
    many = dict(files) | {f'q"uote/{k}.ts': "" for k in range(50)} | {"a/b": "hidden by the directory", "no.language": ""}
    df = frame(spark, many)
    got = {r.directory: json.loads(r.tree) for r in merkle.nested(df).collect()}
    assert got[""] == plain_tree(many) and got["a/b"] == plain_tree([p for p in many if p.startswith("a/b/")], "a/b/")
    monkeypatch.setattr(merkle, "_RUN", 200)
    wide = spark.range(20_000).select(F.concat(F.lit("w/"), F.sha2(F.col("id").cast("string"), 256), F.lit(".py")).alias("path"))
    own = {r.directory: json.loads(r.tree) for r in merkle.nested(wide.unionByName(df.select("path"))).collect()}
    names = [x["path"] for x in own["w"]]
    assert len(names) == 20_000 and names == sorted(names) and own["a"] == got["a"]
    assert [r.tree for r in merkle.nested(df, "many/", summaries=True).where("directory = 'sub'").collect()] == ['[{"language":"python","path":"many/sub/s.py","symbol_count":0,"summary":"","type":"file"}]']
    assert merkle.nested(df, "nothing").count() == 0
