"""Golden vectors of the line engine."""

import io
import random

import pytest
import regex
from pyspark.sql import functions as F

from rowforge import cli
from rowforge.errors import InvalidArguments, InvalidRegex
from rowforge.operators.ordering import positions
from rowforge.plans.options import TextJob
from rowforge.plans.planner import plan
from rowforge.plans.ranges import Rows, columns, merged
from rowforge.sources.lines import from_files, from_lines, from_table
from rowforge.sources.sinks import chunks, edit_in_place, would_change

WORDS = "delta foo\nalpha foo\ncharlie foo\nbravo foo\n"
FRUIT = "fruit,3\nveg,10\nfruit,4\n"
C = {"fields": ","}

# Inputs, options and outputs that the survey's golden vectors (FIXTURES.md, section 2) state.
VECTORS = [
    (WORDS, {}, WORDS),
    (WORDS, {"cols": "7-9", "find": ("foo",), "replace": ("BAR",)}, "delta BAR\nalpha BAR\ncharlie foo\nbravo BAR\n"),
    (WORDS, {"rows": "~2-~1"}, "charlie foo\nbravo foo\n"),
    (WORDS, {"rows": "2-~2"}, "alpha foo\ncharlie foo\n"),
    (WORDS, {"delete": True, "cols": "7-9"}, "delta \nalpha \ncharlioo\nbravo \n"),
    (WORDS, {"grep": "^(a|b)"}, "alpha foo\nbravo foo\n"),
    (WORDS, {"grep": "^(a|b)", "invert": True}, "delta foo\ncharlie foo\n"),
    (WORDS, {"upper": True, "cols": "1-3"}, "DELta foo\nALPha foo\nCHArlie foo\nBRAvo foo\n"),
    ("ABCabcąłć😊😍😁123śę\n", {"cols": "10-12"}, "😊😍😁\n"),
    ("ABCabcąłć😊😍😁123śę\n", {"cols": "20-30"}, "\n"),
    ("Test01234567891231234567\n", {"cols": "15-20", "find": ("123",), "replace": ("ABCD",)}, "Test0123456789ABCDABCD4567\n"),
    (FRUIT, {**C, "group_by": "1", "count": True, "sum": "2", "avg": "2"}, "fruit,2,7,3.5\nveg,1,10,10\n"),
    ("a,3\nb,-1.5\nc,7\n", {**C, "min": "2", "max": "2"}, "-1.5,7\n"),
    ("b,1\na,2\nb,3\na,4\n", {**C, "sort": True, "group_by": "1", "sum": "2"}, "a,6\nb,4\n"),
    ("a,1\na,x\na,3\n", {**C, "count": True, "sum": "2", "avg": "2"}, "3,4,2\n"),
    ("a,x\n", {**C, "min": "2", "avg": "2"}, ",\n"),
    ("", {"count": True}, "0\n"),
    ("", {**C, "count": True, "group_by": "1"}, ""),
    ('a,"b,c",d\nx,"y,z",w\n', {**C, "cols": "2"}, '"b\n"y\n'),
    ('a,"b,c",d\nx,"y,z",w\n', {**C, "quoted": True, "cols": "2,1"}, '"b,c",a\n"y,z",x\n'),
    ("a,b,c\n", {**C, "cols": "3,1", "output_delimiter": " | "}, "c | a\n"),
    ("a,bb,ccc\n", {**C, "cols": "2-3", "output_delimiter": ";"}, "bb,ccc\n"),
    ("a,b,c,d\n", {**C, "delete": True, "cols": "1,3"}, "b,d\n"),
    ("x;30\ny;4\nz;19\n", {"fields": ";", "sort": True, "numeric": True, "cols": "2"}, "y;4\nz;19\nx;30\n"),
    ("7\n-inf\nNaN\nabc\n", {"sort": True, "numeric": True}, "NaN\nabc\n-inf\n7\n"),
    ("zz\nabc\nxy\n", {"sort": True, "cols": "5-6"}, "zz\nabc\nxy\n"),
    ("Xa\nXb\nXc\nXd\nXe\nXf\nXg\n", {"delete": True, "cols": "1", "tac": True, "rows": "2-3,6-7"}, "Xa\nc\nb\nXd\nXe\ng\nf\n"),
    ("one\ntwo\none\nthree\n", {"unique": True}, "one\ntwo\nthree\n"),
    ("b 2\na 1\nb 9\n", {"sort": True, "unique": True, "cols": "1-1"}, "a 1\nb 2\n"),
    ("a,1\nb,\nc,\nd,1\n", {**C, "unique": True, "cols": "2"}, "a,1\nb,\n"),
    ("abcdefg\nhi\n", {"wrap": 3}, "abc\ndef\ng\nhi\n"),
    ("a,b,c\nd\n", {"split_on": ","}, "a\nb\nc\nd\n"),
    ("a,b\nc\n", {"split_on": ",", "join": ","}, "a,b,c\n"),
    ("a\n   \nb\n\n", {"trim": True, "drop_empty": True}, "a\nb\n"),
    ("a\nb\nc\n", {"number": True, "grep": "[ac]"}, "1\ta\n2\tc\n"),
    ("  hello   WIDE world  \n", {"title_case": True, "squeeze": True, "trim": True}, "Hello Wide World\n"),
    ("o'neill-smith\nłódź ma ŁADNE ulice\n", {"title_case": True}, "O'Neill-Smith\nŁódź Ma Ładne Ulice\n"),
    ("ŁÓDŹ łódź Łódź\n", {"ignore_case": True, "find": ("łódź",), "replace": ("X",)}, "X X X\n"),
    ("xA$1Bx\n", {"ignore_case": True, "find": ("a$1b",), "replace": ("$0",)}, "x$0x\n"),
    ("user@host\n", {"regex": True, "find": (r"(\w+)@(\w+)",), "replace": ("$2.$1",)}, "host.user\n"),
    ("baac\n", {"regex": True, "find": ("a*",), "replace": ("X",)}, "XbXcX\n"),
    ("\n", {"regex": True, "find": ("^$",), "replace": ("X",)}, "\n"),
    ("cat dog\n", {"find": ("cat", "dog"), "replace": ("dog", "wolf")}, "wolf wolf\n"),
    ("b\r\na\r\n", {"sort": True}, "a\r\nb\r\n"),
    ("b\na", {"sort": True}, "a\nb\n"),
    ("  a   b,c  \n   \n", {"squeeze": True, "trim": True, "split_on": ",", "wrap": 2, "drop_empty": True, "number": True}, "1\ta \n2\tb\n3\tc\n"),
    ("b,x\na,x\n", {**C, "sort": True, "sort_key": "1", "cols": "2", "find": ("x",), "replace": ("X",)}, "a,X\nb,X\n"),
    ("a,10,20\n", {**C, "sum": "2,3"}, "0\n"),
]


def run(spark, text, options):
    import re

    return b"".join(chunks(plan(TextJob(**options), from_lines(spark, re.findall(r"[^\n]*\n|[^\n]+", text))))).decode()


@pytest.mark.parametrize("text,options,expected", VECTORS)
def test_vector(spark, text, options, expected):
    assert run(spark, text, options) == expected


def test_ranges():
    assert merged([(5, 7), (1, 2), (3, 4)]) == [(1, 7)]
    assert columns("3,1,5-") == [(3, 3), (1, 1), (5, None)]
    assert Rows.parse("~10-~1").resolve(3) == [(1, 3)]
    assert Rows.parse("~5").resolve(3) == []
    for bad in ("0", "3-2", "1-2-3", "x", "~1-~2", ""):
        with pytest.raises(InvalidArguments):
            Rows.parse(bad)


@pytest.mark.parametrize(
    "options",
    [
        {"fields": ","}, {"quoted": True, "cols": "1"}, {"numeric": True}, {"sort": True, "tac": True}, {"upper": True, "lower": True},
        {"number": True, "sort": True}, {"group_by": "1"}, {"quiet": True}, {"find": ("a",)}, {"replace": ("a",)}, {"delete": True},
        {"delete": True, "rows": "1", "sort": True}, {"ignore_case": True}, {"split_on": ""}, {"wrap": 0}, {"delete": True, "cols": "1", "unique": True},
    ],
)
def test_rejected(options):
    with pytest.raises(InvalidArguments):
        TextJob(**options).validate()


def test_regex_dialect(spark):
    for bad in (r"(?=a)", r"(a)\1", "(", "(?<!x)y"):
        with pytest.raises(InvalidRegex):
            run(spark, "a\n", {"grep": bad})


def test_positions_by_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long")
    for desc in (False, True):
        order = [("k", desc), ("i", False)]
        one = {(r.k, r.i): r.pos for r in positions(df, order).collect()}
        many = {(r.k, r.i): r.pos for r in positions(df, order, one_task=10, per_range=200).collect()}
        assert one == many and sorted(one.values()) == list(range(1, 3001))


def test_select_and_delete_are_complements(spark):
    text = "".join(f"row {i}\n" for i in range(40))
    kept, gone = (run(spark, text, {"rows": "3-9,20-~5", "delete": d}).splitlines() for d in (False, True))
    assert sorted(kept + gone) == sorted(text.splitlines())


def test_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_bytes(b"x\nlast")
    b.write_bytes(b" first\ny\r\nz")
    assert b"".join(chunks(plan(TextJob(), from_files(spark, [str(a), str(b)])))) == b"x\nlast first\ny\r\nz"
    job = TextJob(find=("y",), replace=("Y",))
    assert list(would_change(spark, job, [str(a), str(b)]).values()) == [False, True]
    edit_in_place(spark, job, [str(b)], ".bak")
    assert b.read_bytes() == b" first\nY\r\nz" and (tmp_path / "b.bak").read_bytes() == b" first\ny\r\nz"


def test_files_in_many_splits(spark, tmp_path):
    """Lines are numbered in the order of bytes however files are split, without a sort."""
    rng = random.Random(3)
    texts = ["".join(f"{i} {'x' * rng.randint(0, 90)}\n" for i in range(400)) + "end", "", "a\n" * 50, "\n\n" + "y" * 3000 + "\nz"]
    for i, t in enumerate(texts):
        (tmp_path / str(i)).write_text(t)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = from_files(spark, [str(tmp_path / str(i)) for i in range(4)])
        assert lines.df.rdd.getNumPartitions() > 10
        got = lines.df.collect()
        assert b"".join(chunks(plan(TextJob(), lines))) == "".join(texts).encode()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.content for r in sorted(got, key=lambda r: r.row_no)] == "".join(texts).split("\n")
    assert sorted(r.row_no for r in got) == list(range(1, lines.total + 1))


def test_invalid_utf8_names_the_line(spark, tmp_path):
    bad = tmp_path / "bad"
    bad.write_bytes(b"ok\n\xff\xfe\n")
    with pytest.raises(Exception, match="line 2"):
        b"".join(chunks(plan(TextJob(upper=True), from_files(spark, [str(bad)]))))


def run_cli(spark, *args, stdin=b""):
    out = io.BytesIO()
    return cli.main(list(args), spark, stdin=io.BytesIO(stdin), stdout=out), out.getvalue()


def test_cli(spark, tmp_path):
    f = tmp_path / "f"
    f.write_text("a\nb\n")
    assert run_cli(spark, "--count", "-g", "NOTHING", str(f)) == (1, b"0\n")
    assert run_cli(spark, "-R", "1", "-", stdin=b"p\nq\n") == (0, b"p\n")
    assert run_cli(spark, str(f), "-", "-", stdin=b"c") == (0, b"a\nb\nc")
    assert run_cli(spark, "-g", "b", str(f)) == (0, b"b\n") and run_cli(spark, "-g", "c", str(f)) == (1, b"")
    assert run_cli(spark, "-d", "-g", "[ab]", str(f)) == (0, b"")


def test_cli_output(spark, tmp_path):
    f, out, link = tmp_path / "f", tmp_path / "out", tmp_path / "link"
    f.write_text("a\nb\n")
    link.symlink_to(f)
    assert run_cli(spark, "--upper", "-o", str(out), str(f)) == (0, b"") and out.read_bytes() == b"A\nB\n"
    for alias in (f, link):
        assert run_cli(spark, "-o", str(alias), str(f))[0] == 2 and f.read_bytes() == b"a\nb\n"
    assert run_cli(spark, "-o", str(tmp_path / "no" / "such"), str(f))[0] == 2
    assert run_cli(spark, str(tmp_path / "absent"))[0] == 2
    assert [run_cli(spark, "-q", "-g", g, str(f)) for g in "bc"] == [(0, b""), (1, b"")]
    assert run_cli(spark, "-i", "--backup", "/no/such", "--upper", str(f))[0] == 2 and f.read_bytes() == b"a\nb\n"


def test_cli_bad_utf8(spark, tmp_path, capsys):
    """A line that is worked on names itself and gives 2; lines that are kept or left out are not looked at."""
    bad = tmp_path / "bad"
    bad.write_bytes(b"ok\n\xff\xfe\n")
    for args in (["--upper"], ["-d", "-g", "ok"], ["-s"], ["-i", "--upper"]):
        assert run_cli(spark, *args, str(bad))[0] == 2
        assert "line 2" in capsys.readouterr().err
    assert bad.read_bytes() == b"ok\n\xff\xfe\n" and sorted(x.name for x in tmp_path.iterdir()) == ["bad"]
    assert run_cli(spark, "--upper", "-", stdin=b"a\nb\n\xff\n")[0] == 2 and "line 3" in capsys.readouterr().err
    assert run_cli(spark, "-R", "1", "-", stdin=b"ok\n\xff\n") == (0, b"ok\n")
    assert run_cli(spark, "-d", "-R", "1", str(bad)) == (0, b"\xff\xfe\n")


def test_cli_broken_pipe(spark, tmp_path):
    class Closed(io.BytesIO):
        def write(self, data):
            raise BrokenPipeError

    f = tmp_path / "f"
    f.write_text("line\n" * 1000)
    assert cli.main([str(f)], spark, stdout=Closed()) == 0


def test_order_is_enough(spark):
    """Jobs that need no row numbers do not number rows; those that do agree with them."""
    rows = [(i * 7 % 100, f"{i % 5},{i % 3}") for i in range(100)]
    table = spark.createDataFrame(rows, "id long, line string").repartition(4)
    in_order = [line for _, line in sorted(rows)]
    lines = from_table(table, [F.col("line")], ",", ["id"], unique=True)
    assert not lines.dense and lines._total is None
    assert plan(TextJob(count=True), lines).to_table().collect()[0][0] == 100 and lines._total is None
    text = lambda job: [r.content for r in plan(job, lines).to_text().collect()]
    assert text(TextJob()) == in_order and text(TextJob(tac=True)) == in_order[::-1]
    assert text(TextJob(rows="10-20")) == in_order[9:20]
    first = list(dict.fromkeys(in_order))
    assert text(TextJob(unique=True)) == first and text(TextJob(unique=True, tac=True)) == list(dict.fromkeys(in_order[::-1]))
    assert text(TextJob(unique=True, sort=True, reverse=True)) == sorted(first, reverse=True)
    numeric = from_lines(spark, ["x\n", "2\n", "10\n", "y\n", "2\n", "x\n"])
    assert [r.content for r in plan(TextJob(sort=True, numeric=True, reverse=True, unique=True), numeric).to_text().collect()] == ["10", "2", "x", "y"]
    assert plan(TextJob(unique=True, count=True), lines).to_table().collect()[0][0] == len(first)
    assert [tuple(r) for r in plan(TextJob(number=True), lines).to_table().orderBy("pos").collect()] == [(i, f"{i}\t{x}") for i, x in enumerate(in_order, 1)]


def test_title_case_and_wrap(spark):
    def title(t):
        return "".join(w[0].upper() + "".join(c.lower() for c in w[1:]) for w in regex.findall(r"[\p{Alphabetic}\p{N}]+|[^\p{Alphabetic}\p{N}]+", t))

    for t in ("ΟΔΟΣ ΟΔΥΣΣΕΑΣ", "İSTANBUL ıI", "straße ß ﬁn", "o'NEILL x2Y ⅧA ⓐB", "", "  -- "):
        assert run(spark, t + "\n", {"title_case": True}) == title(t) + "\n"
    for t in ("", "a😊b漢c", "x" * 100, "ab\rc d"):
        for n in (1, 3, 40):
            want = [t[i : i + n] for i in range(0, len(t), n)] or [""]
            assert run(spark, t + "\n", {"wrap": n}) == "".join(x + "\n" for x in want)


def test_stream(spark, tmp_path):
    from rowforge.streaming.lines import read_stream, stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text(FRUIT)
    frame = stream(TextJob(fields=",", group_by="1", sum="2"), read_stream(spark, str(tmp_path / "in")))
    q = frame.writeStream.outputMode("complete").format("memory").queryName("fruit").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("fruit").collect()} == {("fruit", 7.0), ("veg", 10.0)}
    with pytest.raises(InvalidArguments):
        stream(TextJob(sort=True), spark.table("fruit"))
