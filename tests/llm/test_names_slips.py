from netledger.llm.names import Words, link_names, slip_pairs, spelling_pairs, weighed
from tests.llm.test_names import CROWD


def test_cut_and_misspelt_names_are_linked(spark):
    groups = [
        ["Lirbronem Linku Fibre AB", "Lir. Lniku Fibre AB"],
        ["Memtefol Damla Systems Inc.", "MemDmala"],
        ["Hudakam Karku Hosting AB", "Karku, Hudakam Hosting", "Hu Karuk Hosting AB"],
        ["AS-KRAMRAMLOSMILDA", "Kram Milda Fibre AB"],
    ]
    names = [n for g in groups for n in g]
    df = spark.createDataFrame([(n,) for n in [*names, *CROWD]], "name string")
    got = {tuple(r) for r in spelling_pairs(link_names(df)).collect() if set(r) & set(names)}
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_slips_among_many_names_are_other_names():
    few, many = Words(500), Words(10**6)
    assert weighed(0.95, ["hambre", "kit"], ["hombre", "kit"], [], few) == 0.95 and weighed(0.95, ["hambre", "kit"], ["hombre", "kit"], [], many) == 0.5
    assert weighed(0.95, ["kitorul", "pindo"], ["kitorul", "pimdo"], [], many) == 0.95 and weighed(1.0, ["kit", "hombre"], ["kit", "hombre"], [], many) == 1.0
    assert weighed(0.6, ["dola", "vi"], ["dolta", "vimtrulvor"], [], many) == 0.0 and weighed(0.7, ["dolta", "vi"], ["dolta", "vimtrulvor"], [], many) == 0.7


def test_pairs_of_one_slip(spark):
    nodes = spark.createDataFrame([(1, ["kit", "linku"]), (2, ["kitorul", "lniku"]), (3, ["kitorul", "linko"]), (4, ["mit", "lniku"]), (5, ["linku"])], "node long, rare array<string>")
    assert {tuple(r) for r in slip_pairs(nodes).distinct().collect()} == {(1, 2), (1, 3)}
