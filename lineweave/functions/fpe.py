"""Format-preserving encryption FF1 of NIST SP 800-38G over AES, in Python."""

from __future__ import annotations

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"


def _sbox() -> list[int]:
    p = q = 1
    box = [0] * 256
    box[0] = 0x63
    while True:
        p = (p ^ (p << 1) ^ (0x1B if p & 0x80 else 0)) & 0xFF
        for k in (1, 2, 4):
            q ^= q << k
        q &= 0xFF
        if q & 0x80:
            q ^= 0x09
        r = 0
        for k in range(5):
            r ^= (q << k | q >> (8 - k)) & 0xFF
        box[p] = r ^ 0x63
        if p == 1:
            return box


_BOX = _sbox()


def _double(b: int) -> int:
    return ((b << 1) ^ (0x1B if b & 0x80 else 0)) & 0xFF


class Aes:
    """Encryption of single blocks with a key of 16, 24 or 32 bytes."""

    def __init__(self, key: bytes) -> None:
        if len(key) not in (16, 24, 32):
            raise ValueError("a key has 16, 24 or 32 bytes")
        n, self.rounds = len(key) // 4, len(key) // 4 + 6
        w = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
        c = 1
        for i in range(n, 4 * (self.rounds + 1)):
            t = w[i - 1]
            if i % n == 0:
                t = [_BOX[b] for b in t[1:] + t[:1]]
                t[0] ^= c
                c = _double(c)
            elif n > 6 and i % n == 4:
                t = [_BOX[b] for b in t]
            w.append([a ^ b for a, b in zip(w[i - n], t)])
        self.keys = [sum(w[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]

    def block(self, data: bytes) -> bytes:
        s = [a ^ b for a, b in zip(data, self.keys[0])]
        for r in range(1, self.rounds + 1):
            s = [_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < self.rounds:
                mixed = []
                for c in range(0, 16, 4):
                    a = s[c : c + 4]
                    whole = a[0] ^ a[1] ^ a[2] ^ a[3]
                    mixed += [a[i] ^ whole ^ _double(a[i] ^ a[(i + 1) % 4]) for i in range(4)]
                s = mixed
            s = [a ^ b for a, b in zip(s, self.keys[r])]
        return bytes(s)


class Ff1:
    """Letters of the text are digits in ``radix``; anything else raises ValueError."""

    def __init__(self, key: bytes, tweak: bytes, radix: int) -> None:
        if not 2 <= radix <= len(ALPHABET):
            raise ValueError(f"a radix is between 2 and {len(ALPHABET)}")
        self.aes, self.tweak, self.radix = Aes(key), tweak, radix

    def encrypt(self, text: str) -> str:
        return self._run(text, range(10), 1)

    def decrypt(self, text: str) -> str:
        return self._run(text, range(9, -1, -1), -1)

    def _run(self, text: str, rounds: range, sign: int) -> str:
        digits = [ALPHABET.index(c) for c in text]
        if any(d >= self.radix for d in digits) or len(digits) < 2:
            raise ValueError("not a numeral string of this radix")
        r, n = self.radix, len(digits)
        u, v = n // 2, n - n // 2
        number = lambda x: int("0") if not x else self._number(x)
        b = -(-((r**v - 1).bit_length()) // 8)
        d = 4 * -(-b // 4) + 4
        p = bytes([1, 2, 1]) + r.to_bytes(3, "big") + bytes([10, u % 256]) + n.to_bytes(4, "big") + len(self.tweak).to_bytes(4, "big")
        x, y = digits[:u], digits[u:]
        for i in rounds:
            if sign < 0:
                x, y = y, x
            q = self.tweak + bytes((-len(self.tweak) - b - 1) % 16) + bytes([i]) + number(y).to_bytes(b, "big")
            t = bytes(16)
            for k in range(0, len(p + q), 16):
                t = self.aes.block(bytes(a ^ c for a, c in zip(t, (p + q)[k : k + 16])))
            s = t
            for j in range(1, -(-d // 16)):
                s += self.aes.block(bytes(a ^ c for a, c in zip(t, j.to_bytes(16, "big"))))
            m = u if i % 2 == 0 else v
            c = (number(x) + sign * int.from_bytes(s[:d], "big")) % r**m
            x, y = (y, self._digits(c, m)) if sign > 0 else (self._digits(c, m), y)
        return "".join(ALPHABET[k] for k in x + y)

    def _number(self, digits: list[int]) -> int:
        out = 0
        for k in digits:
            out = out * self.radix + k
        return out

    def _digits(self, number: int, size: int) -> list[int]:
        out = []
        for _ in range(size):
            number, k = divmod(number, self.radix)
            out.append(k)
        return out[::-1]
