from conftest import rows
from pyspark.sql import functions as F

from furlong.functions import text
from furlong.sources import lines, result_csv

WORDS = "Ankara;x\n1. Kosu : 13.30;a\nAt No;At İsmi;\n1;Şahin ğüçö\n2;İZ\nGanyan\n"


def write(folder, **files):
    folder.mkdir()
    for name, body in files.items():
        (folder / f"{name}.csv").write_bytes(body)
    return str(folder)


def test_encodings_and_line_numbers(spark, tmp_path):
    files = {
        "marked": WORDS.encode("utf-8-sig"), "plain": WORDS.encode(), "turkish": WORDS.encode("cp1254"),
        "latin": "é;ü\n\x81Ý\n".encode("latin-1"), "windows": WORDS.replace("\n", "\r\n").encode("cp1254"), "empty": b"",
        "open": "a\n\nşb".encode(), "middle": "a\n\ufeffb\n".encode(),
    }
    folder = write(tmp_path / "in", **files)
    want = []
    for name, body in files.items():
        for encoding in ("utf-8-sig", "cp1254", "latin-1"):
            try:
                decoded = body.decode(encoding)
                break
            except UnicodeDecodeError:
                continue
        kept = decoded.replace("\r\n", "\n").split("\n")
        kept = kept[:-1] if kept[-1] == "" else kept
        want += [(f"{name}.csv", encoding.removesuffix("-sig"), i, line) for i, line in enumerate(kept)]
    for size in ("128m", "16"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = lines.read_lines(spark, folder)
            assert rows(got.select("file", "encoding", "line_no", "line")) == sorted(want, key=repr)
            if size == "16":
                assert lines.raw_lines(spark, folder).select("path", "block").distinct().count() > 20
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_code_page_round_trip(spark):
    letters = "".join(bytes([b]).decode("cp1254", errors="ignore") for b in range(0x20, 0x100))
    df = spark.createDataFrame([(letters,)], "t string").select("t", text.encode_cp1254("t").alias("b"))
    row = df.select("t", "b", text.is_cp1254("b").alias("ok"), text.decode_as("b", F.lit("cp1254")).alias("back")).first()
    assert bytes(row.b) == letters.encode("cp1254") and row.ok and row.back == letters
    gaps = spark.createDataFrame([(bytearray([b]),) for b in (0x81, 0x8D, 0x8E, 0x8F, 0x90, 0x9D, 0x9E)], "b binary")
    assert gaps.filter(text.is_cp1254("b")).count() == 0


def test_result_files_in_any_encoding(spark, tmp_path):
    folder = write(tmp_path / "in", a=WORDS.encode("utf-8-sig"), b=WORDS.encode("cp1254"))
    got = result_csv.read(spark, folder).select("encoding", "line_no", "race_no", "start_hhmm", "track_raw", "finish_position", "horse_name_raw")
    want = [(e, n, 1, "13:30", "Ankara", i, name) for e in ("utf-8", "cp1254") for n, i, name in ((3, 1, "Şahin ğüçö"), (4, 2, "İZ"))]
    assert rows(got) == sorted(want, key=repr)
