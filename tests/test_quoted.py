import csv
import random

import pytest

from tagweave.sources import read_catalogue, read_quoted_csv
from tagweave.sources.quoted import record_ends

PIECES = ["a", "bc", '"', "\n", ",", "\r\n", "é", "  ", "", '""', "x" * 40]


def write(path, rows, header=("id", "Some Text", "note")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, quoting=csv.QUOTE_NOTNULL, lineterminator="\n")
        out.writerow(header)
        out.writerows(rows)


def some_rows(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(PIECES, k=rng.randrange(6)))
    return [(str(i), text(), rng.choice([None, text()])) for i in range(n)]


@pytest.mark.parametrize("range_bytes", [7, 64, 1000, 1 << 20])
def test_ranges_give_all_rows_once(spark, tmp_path, range_bytes):
    rows = some_rows(range_bytes, 40 if range_bytes < 50 else 400)
    write(f"{tmp_path}/one.csv", rows)
    found = read_quoted_csv(spark, f"{tmp_path}/one.csv", range_bytes=range_bytes)
    assert found.columns == ["id", "Some Text", "note"]
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: int(r[0]))
    assert got == rows
    assert range_bytes > 1000 or found.rdd.getNumPartitions() > 5


def test_folders_headers_and_empty_files(spark, tmp_path):
    write(f"{tmp_path}/a.csv", [("1", "x\ny", "p")])
    write(f"{tmp_path}/b.csv", [("q", "2", "z")], header=("note", "id", "Some Text"))
    write(f"{tmp_path}/c.csv", [])
    for name, text in (("d.csv", ""), ("_SUCCESS", "no,csv"), (".crc", "no")):
        (tmp_path / name).write_text(text)
    (tmp_path / "e.csv").write_bytes(b'\xef\xbb\xbfid,Some Text,note\r\n3,"last, without\nend",r')
    found = read_quoted_csv(spark, str(tmp_path), range_bytes=16)
    assert {tuple(r) for r in found.collect()} == {
        ("1", "x\ny", "p"), ("2", "z", "q"), ("3", "last, without\nend", "r"),
    }
    (tmp_path / "f").mkdir()
    assert read_quoted_csv(spark, f"{tmp_path}/f", ["id"]).count() == 0
    with pytest.raises(FileNotFoundError):
        read_quoted_csv(spark, f"{tmp_path}/none.csv")


def test_missing_columns_are_errors(spark, tmp_path):
    write(f"{tmp_path}/a.csv", [("1", "x", "p")])
    with pytest.raises(Exception, match="has no column other"):
        read_quoted_csv(spark, f"{tmp_path}/a.csv", ["id", "other"]).collect()
    with pytest.raises(ValueError, match="has no column"):
        read_catalogue(spark, f"{tmp_path}/a.csv", "csv", multi_line=True)


def test_record_ends():
    ends, inside = record_ends(b'a\n"b\n"\n"c\n', False)
    assert ends.tolist() == [2, 7] and inside
    assert record_ends(b'b\n"\nc', True)[0].tolist() == [4]
    assert record_ends(b"", True)[1]
