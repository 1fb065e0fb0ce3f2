import json
import random

import pytest

from sievelark.sources import splits
from sievelark.sources.files import read_dataset


def plain_csv(text):
    """Records of a CSV text by a walk over its characters: lists of (line breaks kept) raw records."""
    records, record, field_start, quoted, at = [], "", True, False, 0
    while at < len(text):
        c = text[at]
        record += c
        if quoted:
            if c == '"':
                if text[at + 1 : at + 2] == '"':
                    record += '"'
                    at += 1
                else:
                    quoted = False
        elif c == '"' and field_start:
            quoted, field_start = True, False
        elif c == ",":
            field_start = True
        elif c == "\n":
            records.append(record[:-1])
            record, field_start = "", True
        else:
            field_start = False
        at += 1
    if record:
        records.append(record)
    return records


def odd_csv(seed, rows=40):
    rng = random.Random(seed)
    cells = ["", "plain", '"quoted"', '"a,b"', '"line\nbreak"', '"two\n\nbreaks"', '"say ""hi"""', '""', 'in"side', '"x"tail', '"\n"', "é中",
             '"' + "long\n" * 9 + '"', " ", '"""\n"""', '"a""\n,""b"']
    lines = ["k,a,b,c"]
    for n in range(rows):
        lines.append(",".join([str(n), *(rng.choice(cells) for _ in range(3))]))
        if rng.random() < 0.05:
            lines.append("")
    return "\n".join(lines) + ("\n" if seed % 2 else "")


@pytest.mark.parametrize("seed", range(4))
def test_records_of_any_split_size(spark, tmp_path, seed):
    text = odd_csv(seed)
    (tmp_path / "odd.csv").write_text(text, newline="")
    want = sorted(r for r in plain_csv(text)[1:] if r)
    schema = spark.read.csv(str(tmp_path / "odd.csv"), header=True).schema
    for size in (41, 333):
        own = splits.split_session(spark, size)
        lines = splits._pieces(own, str(tmp_path / "odd.csv"), "\n")
        assert lines.rdd.getNumPartitions() >= len(text.encode()) // size
        got = splits.read_csv_splits(spark, str(tmp_path / "odd.csv"), schema, size).collect()
        whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(tmp_path / "odd.csv")).collect()
        assert len(got) == len(want)
        assert sorted(map(repr, got)) == sorted(map(repr, whole))


def test_crlf_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "dos.csv").write_bytes(b'\xef\xbb\xbf"a","b"\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    got = read_dataset(spark, str(tmp_path / "dos.csv"), split_bytes=6)
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [(1, "x\r\ny"), (2, "z")]


def test_many_files_and_header_that_crosses_splits(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"part{n}.csv").write_text('"a\nlong\nname",b\n' + "".join(f'{n}{k},"t\n{k}"\n' for k in range(n * 3)))
    got = read_dataset(spark, str(tmp_path), "csv", split_bytes=9)
    assert got.columns == ["a\nlong\nname", "b"]
    assert sorted(map(tuple, got.collect())) == sorted((int(f"{n}{k}"), f"t\n{k}") for n in range(3) for k in range(n * 3))


def test_file_that_ends_inside_quotes(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\ny\nz')
    rows = read_dataset(spark, str(tmp_path / "open.csv"), split_bytes=5).collect()
    assert len(rows) == 1 and rows[0].a == 1


def test_small_files_and_the_switches(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a,b\n1,"x\ny"\n')
    assert read_dataset(spark, str(tmp_path / "s.csv")).collect()[0].b == "x\ny"
    assert read_dataset(spark, str(tmp_path / "s.csv"), multi_line=True, split_bytes=3).collect()[0].b == "x\ny"
    assert read_dataset(spark, str(tmp_path / "s.csv"), multi_line=False, split_bytes=3).count() == 2
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert read_dataset(spark, str(tmp_path / "empty.csv"), split_bytes=1).count() == 0


def odd_json(seed, rows=25):
    rng = random.Random(seed)
    texts = ["plain", 'quo"te', "back\\slash", "\\", '\\"', "br{ace", "}", "]", "[{", "new\nline", "é中", "", '"}, {"k": 5}', "\\\\", "x" * 100]
    return [{"k": n, "t": rng.choice(texts), "inner": {"u": [rng.choice(texts), {"deep": rng.choice(texts)}]}} for n in range(rows)]


@pytest.mark.parametrize("seed, indent", [(1, None), (2, 2), (3, None), (4, 1)])
def test_arrays_of_any_split_size(spark, tmp_path, seed, indent):
    rows = odd_json(seed)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(seed % 2)))
    want = sorted(map(json.dumps, rows))
    for size in (83, 999):
        got = read_dataset(spark, str(tmp_path / "a.json"), split_bytes=size)
        assert sorted(json.dumps({"k": r.k, "t": r.t, "inner": {"u": [json.loads(x) if x[:1] == "{" and "deep" in x else x for x in r.inner.u]}})
                      for r in got.collect()) == want


def test_json_other_elements_and_broken_files(spark, tmp_path):
    (tmp_path / "mixed.json").write_text(' \n [1, {"a": 1}, "x{", [2], {"a": {"b": [{}]}} , null, {"a": "}"}]  ')
    lines = spark.read.text(splits.array_to_lines(spark, str(tmp_path / "mixed.json"), 5))
    assert sorted(r.value for r in lines.collect()) == ['{"a": "}"}', '{"a": 1}', '{"a": {"b": [{}]}}']
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a": 2')
    assert spark.read.text(splits.array_to_lines(spark, str(tmp_path / "cut.json"), 4)).collect()[0].value == '{"a": 1}'
    (tmp_path / "cut2.json").write_text('\ufeff[{"a": 1}, {"a": 2}', encoding="utf-8")
    assert spark.read.text(splits.array_to_lines(spark, str(tmp_path / "cut2.json"), 4)).count() == 2
    (tmp_path / "none.json").write_text("[]")
    assert spark.read.text(splits.array_to_lines(spark, str(tmp_path / "none.json"), 1)).count() == 0


def test_a_changed_file_is_an_error(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a\n1\n2\n")
    pieces = splits._pieces(splits.split_session(spark, 3), str(tmp_path / "c.csv"), "\n")
    with pytest.raises(Exception, match="was changed"):
        splits._cut(pieces, {}, splits._CsvCutter, str(tmp_path / "out"), spark).count()


def test_folders_that_name_columns(spark, tmp_path):
    place = str(tmp_path / "parts.csv")
    spark.createDataFrame([(n, f"a\n{n}", n % 2) for n in range(6)], "k long, t string, side long").write.partitionBy("side").csv(
        place, header=True, escape='"')
    assert sorted(map(tuple, read_dataset(spark, place, "csv", split_bytes=3).select("k", "t", "side").collect())) == [
        (n, f"a\n{n}", n % 2) for n in range(6)]
