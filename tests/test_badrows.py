import json
import random

from maldure.operators.badrows import classify_records

FILES = [("a.csv", "csv", ["id", "path", "text", "sample_rate", "duration"], 5, 8000), ("b.jsonl", "jsonl", None, None, None), ("c.csv", "csv", ["audio_path", "sentence"], 2, None)]
FILE_SCHEMA = "file_name string, fmt string, header_columns array<string>, n_columns int, default_sample_rate int, raw_record string"


def classify(spark, lines):
    files = spark.createDataFrame([(*f, "clash") for f in FILES], FILE_SCHEMA)
    rows = spark.createDataFrame([(i, *x, "clash") for i, x in enumerate(lines)], "line_id long, file_name string, raw_line string, reason string")
    return {r["line_id"]: r for r in classify_records(rows, files).collect()}


CSV = [
    ('1,a.wav,hi,16000,1.5', None), ('1,a.wav,hi,16000,1.5\r', None), ('1,"a,b.WAV","say ""x""\nnext", 16000 ,', None), ('1,a.wav,hi,16000', "column_count"), ('1,a.wav,hi,16000,1.5,', "column_count"),
    ('1,a.wav,"hi,16000,1.5', "broken_syntax"), ('1,a.wav,hi "x",16000,1.5', "broken_syntax"), ('1,a.wav,"hi"x,16000,1.5', "broken_syntax"), ('1,a.wav,h\ni,16000,1.5', "broken_syntax"), ('1, "a.wav",hi,16000,1.5', "broken_syntax"),
    ('1,a.mp3,hi,16000,1.5', "invalid_value"), ('1,,hi,16000,1.5', "invalid_value"), ('1,a.wav.part,hi,16000,1.5', "invalid_value"), ('1,a.wav,hi,0,1.5', "invalid_value"), ('1,a.wav,hi,+16000,1.5', "invalid_value"),
    ('1,a.wav,hi,16000.0,1.5', "invalid_value"), ('1,a.wav,hi,,-0.5', "invalid_value"), ('1,a.wav,hi,,1:30', "invalid_value"), ('1,a.flac,hi,, 0 ', None), ('1;a.wav;hi;;', "column_count"), ('id,path,text,sample_rate,duration', "invalid_value"),
    ('1,' + '"' + 'x""' * 20000 + '.wav",hi,,', None), ('1,a.wav,hi,99999999999999,1', None),
]
JSON = [
    ('{"path": "a.wav"}', None), ('{"audio_path": "", "path": "a.PCM", "text": null}', None), ('{"path": "a.wav"} {"path": "a.wav"}', "broken_syntax"), ('[{"path": "a.wav"}]', "broken_syntax"), ("{'path': 'a.wav'}", "broken_syntax"),
    ('{"path": "a.wav", "x": NaN}', "broken_syntax"), ('{"path": "a.wav",}', "broken_syntax"), ('{"path": "a.wav"', "broken_syntax"), ('{"path": "a\tb.wav"}', "broken_syntax"), ('{"path": 7}', "invalid_value"), ('{"audio_path": "a.wav", "path": ["x"]}', "invalid_value"),
    ('{"path": "a.wav", "text": 5}', "invalid_value"), ('{"path": "a.wav", "text": true}', "invalid_value"), ('{"text": "x"}', "invalid_value"), ('{"path": "a.wav", "sample_rate": 16000}', None), ('{"path": "a.wav", "sample_rate": 16000.0}', "invalid_value"),
    ('{"path": "a.wav", "sample_rate": 1e4}', "invalid_value"), ('{"path": "a.wav", "sample_rate": true}', "invalid_value"), ('{"path": "a.wav", "duration": -0.0}', "invalid_value"), ('{"path": "a.wav", "duration": "2.5", "sample_rate": ""}', None), ('"x"', "broken_syntax"),
    ('{"path": "a.wav", "x": "\\ud800"}', None), ('{"path": "a.wav", "deep": ' + "[" * 30 + "]" * 30 + "}", None), ('{"path": "a.wav", "text": "' + "가" * 60000 + '"}', None),
]


def test_reasons(spark):
    lines = [("a.csv", x) for x, _ in CSV] + [("b.jsonl", x) for x, _ in JSON]
    got = classify(spark, lines)
    wrong = [(lines[i][1][:60], got[i]["reason"], want) for i, (_, want) in enumerate(CSV + JSON) if got[i]["reason"] != want]
    assert not wrong


def test_blank_lines_and_unknown_files(spark):
    got = classify(spark, [("a.csv", ""), ("a.csv", " \r"), ("b.jsonl", None), ("b.jsonl", "\u3000"), ("z.csv", "a.wav,b"), ("z.csv", '"'), ("z.jsonl", '{"path": "a.wav"}')])
    assert {i: r["reason"] for i, r in got.items()} == {4: "invalid_value", 5: "broken_syntax", 6: None}


def test_typed_values(spark):
    got = classify(spark, [("a.csv", '7,"a,b.WAV","say ""x""", 16000 ,2.50'), ("b.jsonl", json.dumps({"audio_filepath": "x.wav", "transcript": "안녕", "speaker": "s"})), ("a.csv", "7,a.wav,,,")])
    assert (got[0]["audio_path"], got[0]["text"], got[0]["sample_rate"], got[0]["duration"], got[0]["id"]) == ("a,b.WAV", 'say "x"', 16000, 2.5, "7")
    assert (got[1]["audio_path"], got[1]["text"], got[1]["speaker"], got[1]["sample_rate"]) == ("x.wav", "안녕", "s", None)
    assert got[2]["sample_rate"] == 8000 and got[2]["text"] == ""


def test_random_csv_equals_a_plain_automaton(spark):
    def fields(raw):
        out, field, at = [], "", 0
        while True:
            if raw[at : at + 1] == '"':
                at, field = at + 1, ""
                while True:
                    if at >= len(raw):
                        return None
                    if raw[at] == '"':
                        if raw[at + 1 : at + 2] == '"':
                            field, at = field + '"', at + 2
                            continue
                        at += 1
                        break
                    field, at = field + raw[at], at + 1
            else:
                field = ""
                while at < len(raw) and raw[at] != ",":
                    if raw[at] in '"\r\n':
                        return None
                    field, at = field + raw[at], at + 1
            out.append(field)
            if at == len(raw):
                return out
            if raw[at] != ",":
                return None
            at += 1

    random.seed(5)
    raws = ["".join(random.choice('",a \n') for _ in range(random.randint(1, 9))) for _ in range(400)]
    raws = [r for r in raws if r.strip()]
    got = classify(spark, [("c.csv", r) for r in raws])
    for i, raw in enumerate(raws):
        own = fields(raw)
        want = "broken_syntax" if own is None else "column_count" if len(own) != 2 else "invalid_value"
        assert got[i]["reason"] == want, raw


def test_empty_tables(spark):
    files = spark.createDataFrame([], FILE_SCHEMA)
    lines = spark.createDataFrame([], "line_id long, file_name string, raw_line string")
    assert classify_records(lines, files).count() == 0
