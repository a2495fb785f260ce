"""CSV files whose lines are decoded and parsed by what is known of their file."""

import pytest

from tablescope.sources.csv import load_csv


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_many_files_with_three_headers_are_one_plan(spark, tmp_path):
    heads = ["id,name,note", "note,id,name", "id,note"]
    sizes = []
    for files in (6, 300):
        folder = tmp_path / str(files)
        folder.mkdir()
        want = []
        for k in range(files):
            head = heads[k % 3].split(",")
            encoding = "latin-1" if k % 2 else "utf-8"
            row = {"id": str(k), "name": f"né {k}", "note": f'say ""{k}"", ok'}
            line = ",".join(f'"{row[c]}"' for c in head)
            write(folder, f"f{k}.csv", f"{','.join(head)}\n{line}\n", encoding)
            want.append((k, row["name"] if "name" in head else None, f'say "{k}", ok'))
        found = load_csv(spark, str(folder))
        assert rows(found.df) == sorted(want, key=repr)
        assert len(found.latin1_files) == sum(1 for k in range(files) if k % 2 and k % 3 != 2)
        sizes.append(found.df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[0] == sizes[1]


def test_a_header_line_that_comes_again_is_data(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y\n1,2\nx,y\nx,y\n\n   \n3,4\n")
    write(tmp_path, "b.csv", "x,y\n5,6\n")
    write(tmp_path, "empty.csv", "")
    df = load_csv(spark, str(tmp_path), infer_types=False).df
    assert rows(df) == sorted([("1", "2"), ("x", "y"), ("x", "y"), ("3", "4"), ("5", "6")], key=repr)


@pytest.mark.parametrize(
    "text", ["a,a,,B,b\n1,2,3,4,5\n", 'a,"b c",c\n1,2\n1,2,3,4\n', 'a,b\n"x ""y""", z \n,""\n', "only\r\n1\r\n2\r\n"]
)
def test_lines_are_parsed_as_by_the_reader(spark, tmp_path, text):
    write(tmp_path, "a.csv", text)
    plain = spark.read.options(header=True, quote='"', escape='"').csv(str(tmp_path))
    found = load_csv(spark, str(tmp_path), infer_types=False).df
    assert found.columns == plain.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.select(*[f"`{c}`" for c in plain.columns]).collect()))
