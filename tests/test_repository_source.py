"""A folder of repositories, with links, odd names and files that are no text."""

import os

import pytest
from pyspark.sql import functions as F

from wardline.sources.repositories import RepositorySource


@pytest.fixture
def folder(tmp_path):
    def put(path, data):
        p = tmp_path / "repos" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    put("acme/shop/src/app.js", "const é = 1;\n".encode())
    put("acme/shop/src/empty.js", b"")
    put("acme/shop/README.md", b"shop")
    put("acme/shop/big.bin", b"x" * 3000)
    put("acme/shop/img.png", b"\x89PNG\x00")
    put("acme/shop/nul.txt", b"a\x00b")
    put("acme/Bad_Name/a.js", b"1")
    put("other/tool/a.js", b"2")
    put("acme/loose.txt", b"3")
    for i in range(40):
        put(f"many/r{i}/f.js", str(i).encode())
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "secret.js").write_text("secret")
    shop = tmp_path / "repos/acme/shop"
    os.symlink(outside, shop / "escape")
    os.symlink(outside / "secret.js", shop / "link.js")
    os.symlink(shop / "README.md", shop / "own.md")
    os.symlink(outside, tmp_path / "repos/acme/gone")
    return str(tmp_path / "repos")


def load(spark, folder, **options):
    spark.dataSource.register(RepositorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("wardline_repositories").options(root=folder, mostBytes=2000, **options).load()


def test_rows_and_refusals(spark, folder):
    got = {(r.repo, r.path): (r.content, r.refused) for r in load(spark, folder, owners="ACME, not/valid").collect()}
    assert got == {
        ("acme/shop", "src/app.js"): ("const é = 1;\n", None), ("acme/shop", "src/empty.js"): ("", None), ("acme/shop", "README.md"): ("shop", None), ("acme/shop", "big.bin"): (None, "too large"), ("acme/shop", "img.png"): (None, "not text"), ("acme/shop", "nul.txt"): (None, "not text"),
        ("acme/shop", "escape"): (None, "leads out of the repository"), ("acme/shop", "link.js"): (None, "leads out of the repository"), ("acme/shop", "own.md"): (None, "not a plain file"), ("acme/gone", None): (None, "outside the folder"),
        ("acme/Bad_Name", None): (None, "not a repository's name"), ("acme/loose.txt", None): (None, "not a repository's name"), ("other", None): (None, "owner not allowed"), ("many", None): (None, "owner not allowed"),
    }
    assert {r.refused for r in load(spark, folder, owners=" , /").collect()} == {"owner not allowed"}


def test_partitions_and_pushed_filters(spark, folder):
    every = load(spark, folder)
    assert every.where("repo like 'many/%'").count() == 40 and every.rdd.getNumPartitions() > 2
    one = every.where((F.col("repo") == "acme/shop") & F.col("path").startswith("src/") & (F.col("size") > 0))
    assert [(r.repo, r.path) for r in one.collect()] == [("acme/shop", "src/app.js")]
    assert one.rdd.getNumPartitions() == 1
    assert every.where("repo = 'no/where'").count() == 0
    with pytest.raises(Exception, match="root"):
        spark.read.format("wardline_repositories").load().collect()
