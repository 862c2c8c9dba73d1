"""Hand-checked expectations for the synthesised archive lines (used by the SQL oracle).

Fixed values: (line, ply, position key before the move, move) for lines 0, 1,
2, 3 and 6, and the four-ply cycle of line 7.  Line 4 equals line 0's first
four plies (its annotations and variation are ignored), line 5 line 0's first
two (its third move is illegal), line 7 repeats its cycle up to the 40-ply cap.
"""

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"

GOLDEN = [
    (0, 0, START, "e4"),
    (0, 1, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq -", "e5"),
    (0, 2, "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq -", "Nf3"),
    (0, 3, "rnbqkbnr/pppp1ppp/8/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R b KQkq -", "Nc6"),
    (0, 4, "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq -", "Bb5"),
    (0, 5, "r1bqkbnr/pppp1ppp/2n5/1B2p3/4P3/5N2/PPPP1PPP/RNBQK2R b KQkq -", "a6"),
    (1, 0, START, "e4"),
    (1, 1, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq -", "a6"),
    (1, 2, "rnbqkbnr/1ppppppp/p7/8/4P3/8/PPPP1PPP/RNBQKBNR w KQkq -", "e5"),
    (1, 3, "rnbqkbnr/1ppppppp/p7/4P3/8/8/PPPP1PPP/RNBQKBNR b KQkq -", "d5"),
    (1, 4, "rnbqkbnr/1pp1pppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6", "exd6"),
    (2, 0, START, "f3"),
    (2, 1, "rnbqkbnr/pppppppp/8/8/8/5P2/PPPPP1PP/RNBQKBNR b KQkq -", "e5"),
    (2, 2, "rnbqkbnr/pppp1ppp/8/4p3/8/5P2/PPPPP1PP/RNBQKBNR w KQkq -", "g4"),
    (2, 3, "rnbqkbnr/pppp1ppp/8/4p3/6P1/5P2/PPPPP2P/RNBQKBNR b KQkq -", "Qh4#"),
    (3, 0, START, "e4"),
    (3, 1, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq -", "e5"),
    (3, 2, "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq -", "Nf3"),
    (3, 3, "rnbqkbnr/pppp1ppp/8/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R b KQkq -", "Nc6"),
    (3, 4, "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq -", "Bc4"),
    (3, 5, "r1bqkbnr/pppp1ppp/2n5/4p3/2B1P3/5N2/PPPP1PPP/RNBQK2R b KQkq -", "Bc5"),
    (3, 6, "r1bqk1nr/pppp1ppp/2n5/2b1p3/2B1P3/5N2/PPPP1PPP/RNBQK2R w KQkq -", "O-O"),
    (3, 7, "r1bqk1nr/pppp1ppp/2n5/2b1p3/2B1P3/5N2/PPPP1PPP/RNBQ1RK1 b kq -", "Nf6"),
    (6, 0, "8/P6k/8/8/8/8/7K/8 w - -", "a8=Q"),
    (6, 1, "Q7/7k/8/8/8/8/7K/8 b - -", "Kg7"),
    (7, 0, START, "Nf3"),
    (7, 1, "rnbqkbnr/pppppppp/8/8/8/5N2/PPPPPPPP/RNBQKB1R b KQkq -", "Nf6"),
    (7, 2, "rnbqkb1r/pppppppp/5n2/8/8/5N2/PPPPPPPP/RNBQKB1R w KQkq -", "Ng1"),
    (7, 3, "rnbqkb1r/pppppppp/5n2/8/8/8/PPPPPPPP/RNBQKBNR b KQkq -", "Ng8"),
]

# Main-line tokens per line (line 7: its cycle, 44 tokens in all).
LENIENT_TOKENS = {
    0: ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"],
    1: ["e4", "a6", "e5", "d5", "exd6"],
    2: ["f3", "e5", "g4", "Qh4"],
    3: ["e4", "e5", "Nf3", "Nc6", "Bc4", "Bc5", "O-O", "Nf6"],
    4: ["e4", "e5", "Nf3", "Nc6"],
    5: ["e4", "e5", "Qxe5", "Nc6"],
    6: ["a8=Q", "Kg7"],
}
STRICT_TOKENS = {
    0: ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"],
    1: ["e4", "a6", "e5", "d5", "exd6"],
    2: ["f3", "e5", "g4", "Qh4#"],
    3: ["e4", "e5", "Nf3", "Nc6", "Bc4", "Bc5", "O-O", "Nf6"],
    4: [],
    5: ["e4", "e5", "Qxe5", "Nc6"],
    6: ["a8=Q", "Kg7"],
}
LINE_7_CYCLE = ["Nf3", "Nf6", "Ng1", "Ng8"]
LINE_7_TOKENS = 44

# Full FEN after the first n tokens (n = 0..4) played from the
# standard start, or None when the sequence is not playable from there.
SEQUENCE_FENS = {
    (0, 0): "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    (0, 1): "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1",
    (0, 2): "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2",
    (0, 3): "rnbqkbnr/pppp1ppp/8/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R b KQkq - 1 2",
    (0, 4): "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 2 3",
    (1, 2): "rnbqkbnr/1ppppppp/p7/8/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2",
    (1, 3): "rnbqkbnr/1ppppppp/p7/4P3/8/8/PPPP1PPP/RNBQKBNR b KQkq - 0 2",
    (1, 4): "rnbqkbnr/1pp1pppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6 0 3",
    (2, 1): "rnbqkbnr/pppppppp/8/8/8/5P2/PPPPP1PP/RNBQKBNR b KQkq - 0 1",
    (2, 2): "rnbqkbnr/pppp1ppp/8/4p3/8/5P2/PPPPP1PP/RNBQKBNR w KQkq - 0 2",
    (2, 3): "rnbqkbnr/pppp1ppp/8/4p3/6P1/5P2/PPPPP2P/RNBQKBNR b KQkq - 0 2",
    (2, 4): "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3",
    (5, 3): None,
    (5, 4): None,
    (6, 1): None,
    (6, 2): None,
    (6, 3): None,
    (6, 4): None,
    (7, 1): "rnbqkbnr/pppppppp/8/8/8/5N2/PPPPPPPP/RNBQKB1R b KQkq - 1 1",
    (7, 2): "rnbqkb1r/pppppppp/5n2/8/8/5N2/PPPPPPPP/RNBQKB1R w KQkq - 2 2",
    (7, 3): "rnbqkb1r/pppppppp/5n2/8/8/8/PPPPPPPP/RNBQKBNR b KQkq - 3 2",
    (7, 4): "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 4 3",
}
# Lines 1, 2, 5, 6, 7 share line 0's n = 0 row; lines 1 and 5 its n = 1 row;
# line 5 its n = 2 row; lines 3 and 4 all of line 0's rows.
SEQUENCE_SAME_AS = {(1, 0): (0, 0), (2, 0): (0, 0), (5, 0): (0, 0), (6, 0): (0, 0), (7, 0): (0, 0),
                    (1, 1): (0, 1), (5, 1): (0, 1), (5, 2): (0, 2)}
SEQUENCE_SAME_AS.update({(line, n): (0, n) for line in (3, 4) for n in range(5)})


def sequence_fen(line: int, n: int):
    key = SEQUENCE_SAME_AS.get((line, n), (line, n))
    return SEQUENCE_FENS[key]
