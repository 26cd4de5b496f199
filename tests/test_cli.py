import json
import os

from codequarry.__main__ import main
from codequarry.sources.tables import synth_code, table

SF = "/root/testdata/sf0.001"


def test_cli_stages(spark, tmp_dir, capsys):
    corpus = os.path.join(tmp_dir, "corpus")
    synth_code(table(spark, SF, "documents")).select("code_id", "code").write.parquet(corpus)
    ds, ans, sc = (os.path.join(tmp_dir, x) for x in ("ds", "answers", "scores"))
    assert main(["build", "--corpus", corpus, "--out", ds, "--n", "3"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["records"] == 3 * 9 * 16
    assert main(["answer", "--records", ds, "--out", ans, "--model", "stub", "--prompt-mode", "question_only"],
                spark) == 0
    assert main(["evaluate", "--answers", ans, "--model", "stub", "--prompt-mode", "question_only",
                 "--vectors", f"{SF}/embeddings.parquet", "--out", sc, "--samples", "best"], spark) == 0
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert set(report) == {"overall", "by_primary"} and len(report["by_primary"]) == 4
