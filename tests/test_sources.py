import codecs

from rookery.plans.views import Domain
from rookery.sources import files


def test_csv_corpus(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,city\nAda,Zürich\nBo,Köln\n".encode())
    (tmp_path / "b.csv").write_bytes("name;city\nC;東京\nD;大阪\n".encode("shift_jis"))
    (tmp_path / "c.csv").write_bytes("name\tcity\nE\tx\n".encode())
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.7 ...")
    got = {}
    for r in files.read_csv_corpus(spark, str(tmp_path)).collect():
        got.setdefault(r.file, []).append(r.record)
    assert sorted(got["a.csv"]) == ["name: Ada, city: Zürich", "name: Bo, city: Köln"]
    assert sorted(got["b.csv"]) == ["name: C, city: 東京", "name: D, city: 大阪"]
    assert got["c.csv"] == ["name: E, city: x"]
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in files.file_kinds(spark, str(tmp_path)).collect()}
    assert kinds == {"a.csv": "csv", "b.csv": "csv", "c.csv": "csv", "d.pdf": "pdf"}


def test_each_file_has_its_own_header_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(codecs.BOM_UTF8 + b"name,city\nAda,Rome\n")
    (tmp_path / "b.csv").write_bytes(b"price,sku\n10,X1\n")
    (tmp_path / "c.csv").write_bytes(b'note,by\n"two\nlines, one field",me\nshort\n1,2,3\n')
    for k, name in enumerate(["shift_jis", "cp932", "euc-jp", "iso-2022-jp"]):
        (tmp_path / f"e{k}.csv").write_bytes(f"名前,品\n山田,{'①' if name == 'cp932' else '本'}\n".encode(name))
    (tmp_path / "f.csv").write_bytes(("x,y\n" + "a,b\n" * 30_000 + "ä,東\n").encode("euc-jp", "ignore"))
    (tmp_path / "g.csv").write_bytes(b"")
    dialects = {r.path.rsplit("/", 1)[1]: (r.encoding, r.delimiter) for r in files.csv_dialects(spark, str(tmp_path)).collect()}
    assert [dialects[f"e{k}.csv"][0] for k in range(4)] == ["shift_jis", "cp932", "euc-jp", "iso-2022-jp"]
    assert dialects["a.csv"] == ("utf-8", ",")
    got = {}
    for r in files.read_csv_corpus(spark, str(tmp_path), rows=1000).orderBy("file", "record_no").collect():
        got.setdefault(r.file, []).append(r.record)
    assert got["a.csv"] == ["name: Ada, city: Rome"] and got["b.csv"] == ["price: 10, sku: X1"]
    assert got["c.csv"] == ["note: two\nlines, one field, by: me", "note: short, by: ", "note: 1, by: 2, 3: 3"]
    assert got["e1.csv"] == ["名前: 山田, 品: ①"] and len(got["f.csv"]) == 30_001 and got["f.csv"][-1].endswith("y: 東")
    assert "g.csv" not in got


def test_export_and_append(spark, tmp_path):
    chat = Domain(spark, "/root/testdata/sf0.001").chat_history
    files.export_chat_csv(chat, f"{tmp_path}/out")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert back.count() == chat.count() and len(back.columns) == 10
    rows = spark.createDataFrame([("1", "a"), (None, "b")], "id string, v string")
    files.append_rows(rows, f"{tmp_path}/t")
    files.append_rows(rows, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").where("id IS NOT NULL").count() == 4


def test_union_keeps_all_columns(spark):
    one, two = spark.createDataFrame([(1, "a")], "id long, file string"), spark.createDataFrame([(2, "u")], "id long, url string")
    assert sorted(tuple(r) for r in files.union_knowledge([one, two]).select("id", "file", "url").collect()) == [(1, "a", None), (2, None, "u")]
