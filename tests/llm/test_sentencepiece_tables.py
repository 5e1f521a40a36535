import pickle

from pairsmith.llm.sentencepiece import Pieces, encode


def test_tasks_of_a_process_share_tables():
    """Each task gets a Pieces of its own; a worker that has many tasks makes the tables once and keeps one set of them."""
    pickled = pickle.dumps(Pieces.load())
    one, other = pickle.loads(pickled), pickle.loads(pickled)
    ids = [encode(p, ["some  words   and spaces  ", None])[0].tolist() for p in (one, other)]
    assert one.tables() is other.tables() and ids[0] == ids[1]
    few = Pieces(other.texts[:-1], other.scores[:-1], other.byte_ids, other.special)
    assert few.tables() is not other.tables() and other.texts[-1] not in few.tables()["id"]
