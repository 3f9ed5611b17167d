"""Readers of gold units."""

from __future__ import annotations

from sentria.sources import readers


def test_treebank_units_are_bounded(spark, tmp_path):
    """However long a file is, a unit holds a few sentences of it, in order."""
    sents = [f"Sentence {i} ." for i in range(23)]
    text = "# newdoc id = a\n# newpar\n" + "".join(("# newpar id = b\n" if i == 7 else "") + f"# sent_id = {i}\n# text = {x}\n1\t_\t_\n\n" for i, x in enumerate(sents))
    (tmp_path / "one.conllu").write_text(text, encoding="utf-8")
    (tmp_path / "two.conllu").write_text("# text = Alone.\n1\t_\t_\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        units = [x.gold for x in readers.conll_u(spark, f"file://{tmp_path}", "en").orderBy("text").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(units) == sorted([sents[:5], sents[5:7], sents[7:12], sents[12:17], sents[17:22], sents[22:], ["Alone."]])
