"""Joins of tables that grow with the documents are shuffled whatever their size is here."""

import pytest

from peakloom.llm import conversations, graph, hmm, jaccard, records, substrings, token_counts


@pytest.fixture
def plans(monkeypatch):
    """The optimised plans of all settled tables and of what `note` is given."""
    found = []

    def note(df):
        found.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    for module in (conversations, graph, hmm, jaccard, records, substrings, token_counts):
        real = module.settle
        monkeypatch.setattr(module, "settle", lambda df, name, real=real: real(note(df), name))
    found.append(note)
    return found


def unhinted(plans):
    lines = [line.strip(" :+-") for plan in plans[1:] for line in plan.splitlines()]
    joins = [line for line in lines if line.startswith("Join ")]
    return len(joins), [j for j in joins if "strategy=merge" not in j]


@pytest.mark.parametrize("name", ["jaccard", "substrings", "token_counts"])
def test_joins_are_shuffled(docs, plans, name):
    plans[0]({"jaccard": jaccard.links, "substrings": substrings.strip, "token_counts": token_counts.count}[name](docs))
    n, left = unhinted(plans)
    assert n >= 2 and not left


def test_scores_join_by_shuffles(docs, plans):
    plans[0](hmm.score(docs))
    n, left = unhinted(plans)
    assert n >= 2 and not left
