"""Kernels on one page image in numpy: levels, skew, noise, contrast, ink, closing, outlines."""

from __future__ import annotations

import math

import numpy as np

# The weights of luminance and colour differences in units of 1/16384.
LUMINANCE = (4899, 9617, 1868)
TO_RED, TO_BLUE = 11682, 9241
FROM_RED, FROM_BLUE, GREEN_RED, GREEN_BLUE = 22987, 29049, -11698, -5636


def grey(rgb: np.ndarray) -> np.ndarray:
    return ((rgb.astype(np.int32) @ np.array(LUMINANCE, np.int32) + 8192) >> 14).astype(np.uint8)


def split_luminance(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Luminance and the differences to red and blue, about 128."""
    y = grey(rgb).astype(np.int32)
    red, blue = (((rgb[..., k].astype(np.int32) - y) * w + (128 << 14) + 8192) >> 14 for k, w in ((0, TO_RED), (2, TO_BLUE)))
    return y.astype(np.uint8), np.clip(red, 0, 255).astype(np.uint8), np.clip(blue, 0, 255).astype(np.uint8)


def join_luminance(y: np.ndarray, red: np.ndarray, blue: np.ndarray) -> np.ndarray:
    y, r, b = y.astype(np.int32), red.astype(np.int32) - 128, blue.astype(np.int32) - 128
    planes = (y + ((r * FROM_RED + 8192) >> 14), y + ((b * GREEN_BLUE + r * GREEN_RED + 8192) >> 14), y + ((b * FROM_BLUE + 8192) >> 14))
    return np.clip(np.stack(planes, axis=-1), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The level that parts a histogram of 256 bins with the greatest variance between both sides, the lowest of equals."""
    count = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    total, below = count.sum(), np.cumsum(count)
    mass = np.cumsum(count * np.arange(256))
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((below > 0) & (above > 0), below * above * (mass / below - (mass[-1] - mass) / above) ** 2, 0.0)
    top = between.max()
    return int(np.flatnonzero(between >= top * (1 - 1e-12))[0]) if top > 0 else 0


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of integer points (x, y), in order; no three on a line."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    p = points[order]
    # of the points of one x only the lowest and the highest can be corners
    new = np.concatenate([[True], p[1:, 0] != p[:-1, 0]])
    ends = np.concatenate([np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))])
    p = np.unique(p[ends], axis=0).tolist()
    if len(p) < 3:
        return np.array(p)

    def half(points):
        out = []
        for x, y in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def box_angle(points: np.ndarray) -> float:
    """Degrees by which the smallest box around the points is turned, in (-45, 45]: positive where lines descend to the
    right (y grows downward). A side of the smallest box lies on a side of the hull."""
    corners = hull(points)
    if len(corners) < 2:
        return 0.0
    side = np.roll(corners, -1, axis=0) - corners
    side = side / np.hypot(side[:, 0], side[:, 1])[:, None]
    along = corners @ side.T
    across = corners @ np.stack([-side[:, 1], side[:, 0]])
    area = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    turns = np.degrees(np.arctan2(side[:, 1], side[:, 0]))
    turns = -((45 - turns) % 90 - 45)  # modulo a quarter, in (-45, 45]
    least = area.min()
    return float(min(turns[area <= least * (1 + 1e-9) + 1e-9], key=abs))


def skew(image: np.ndarray, least_points: int = 50, level: int | None = None) -> float:
    """The angle of the dark points of a grey page, up to ``level`` (its own threshold); 0 where there are too few."""
    dark = image <= (otsu(image) if level is None else level)
    if np.count_nonzero(dark) < least_points:
        return 0.0
    x = np.flatnonzero(dark.any(axis=0))  # of the points of one column only the uppermost and the lowest can be corners
    own = dark[:, x]
    return box_angle(np.stack([np.repeat(x, 2), np.stack([own.argmax(axis=0), len(dark) - 1 - own[::-1].argmax(axis=0)], axis=1).ravel()], axis=1))


def _cubic(t: np.ndarray, a: float = -0.75) -> list[np.ndarray]:
    near, far = 1 - t, 2 - t
    return [((a * (t + 1) - 5 * a) * (t + 1) + 8 * a) * (t + 1) - 4 * a, ((a + 2) * t - (a + 3)) * t * t + 1, ((a + 2) * near - (a + 3)) * near * near + 1, ((a * far - 5 * a) * far + 8 * a) * far - 4 * a]


def turned(rgb: np.ndarray, degrees: float, band: int = 256) -> np.ndarray:
    """The page turned counter-clockwise about its centre, cubic, the edge carried on outside; ``band`` rows at a time."""
    height, width = rgb.shape[:2]
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    out = np.empty_like(rgb)
    x = np.arange(width) - width / 2
    for top in range(0, height, band):
        y = (np.arange(top, min(top + band, height)) - height / 2)[:, None]
        u, v = c * x - s * y + width / 2, s * x + c * y + height / 2
        left, up = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
        wx, wy = _cubic(u - left), _cubic(v - up)
        total = np.zeros((*u.shape, rgb.shape[2]))
        for j in range(4):
            rows = np.clip(up + j - 1, 0, height - 1)
            for i in range(4):
                total += (wy[j] * wx[i])[..., None] * rgb[rows, np.clip(left + i - 1, 0, width - 1)]
        out[top : top + band] = np.clip(np.rint(total), 0, 255)
    return out


def deskewed(rgb: np.ndarray, least: float = 0.5, most: float = 10.0) -> tuple[np.ndarray, float]:
    """The page and the angle it was turned by: none below ``least`` or above ``most`` degrees."""
    angle = skew(grey(rgb))
    return (turned(rgb, angle), angle) if least <= abs(angle) <= most else (rgb, 0.0)


def denoised(plane: np.ndarray, h: float = 5.0, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: a weighted mean over a window of ``search``, the weights falling with the mean squared difference
    of windows of ``template``. One shift of the whole plane at a time; sums over windows come from running sums."""
    t, r = template // 2, search // 2
    wide = np.pad(plane.astype(np.float32), t + r, mode="reflect" if min(plane.shape) > t + r else "edge")
    height, width = plane.shape
    centre = wide[r : r + height + 2 * t, r : r + width + 2 * t]
    total, weights = np.zeros(plane.shape, np.float64), np.zeros(plane.shape, np.float64)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            moved = wide[r + dy : r + dy + height + 2 * t, r + dx : r + dx + width + 2 * t]
            square = (moved - centre).astype(np.float64) ** 2
            run = np.pad(square, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
            mean = (run[template:, template:] - run[:-template, template:] - run[template:, :-template] + run[:-template, :-template]) / template**2
            weight = np.exp(-np.maximum(mean, 0) / (h * h))
            weight[weight < 0.001] = 0
            total += weight * moved[t : t + height, t : t + width]
            weights += weight
    return np.clip(np.rint(total / weights), 0, 255).astype(np.uint8)


def tile_levels(tile: np.ndarray, clip: float = 2.0) -> np.ndarray:
    """The new level of each of 256: the histogram is cut at ``clip`` times its mean, and what is cut off spread evenly."""
    count, area = np.bincount(tile.ravel(), minlength=256), tile.size
    most = max(int(clip * area / 256), 1)
    over = int(np.maximum(count - most, 0).sum())
    count = np.minimum(count, most) + over // 256
    rest = over % 256
    if rest:
        step = max(256 // rest, 1)
        count[np.arange(0, 256, step)[:rest]] += 1
    return np.clip(np.rint(np.cumsum(count) * np.float32(255 / area)), 0, 255).astype(np.uint8)


def equalised(plane: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: levels of ``tiles`` x ``tiles`` tiles, blended between the centres of four."""
    height, width = plane.shape
    down, right = -height % tiles, -width % tiles
    mode = "reflect" if height > down and width > right else "edge"
    whole = np.pad(plane, ((0, down), (0, right)), mode=mode) if down or right else plane
    th, tw = whole.shape[0] // tiles, whole.shape[1] // tiles
    levels = np.array([[tile_levels(whole[i * th : (i + 1) * th, j * tw : (j + 1) * tw], clip) for j in range(tiles)] for i in range(tiles)], np.float32)

    def place(n, size):
        f = np.arange(n, dtype=np.float32) / size - np.float32(0.5)
        low = np.floor(f).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), (f - low).astype(np.float32)

    y1, y2, fy = place(height, th)
    x1, x2, fx = place(width, tw)
    out = np.empty_like(plane)
    for y in range(height):
        upper = levels[y1[y], x1, plane[y]] * (1 - fx) + levels[y1[y], x2, plane[y]] * fx
        lower = levels[y2[y], x1, plane[y]] * (1 - fx) + levels[y2[y], x2, plane[y]] * fx
        out[y] = np.clip(np.rint(upper * (1 - fy[y]) + lower * fy[y]), 0, 255)
    return out


def hue(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in halves of degrees, saturation and value of 0 to 255."""
    c = rgb.astype(np.int32)
    value, low = c.max(axis=-1), c.min(axis=-1)
    d = value - low
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.select([value == r, value == g], [(g - b) / d, 2 + (b - r) / d], 4 + (r - g) / d) * 30
        h = np.where(d > 0, np.rint(np.where(turn < 0, turn + 180, turn)) % 180, 0)
        s = np.where(value > 0, np.rint(255 * d / value), 0)
    return h.astype(np.uint8), s.astype(np.uint8), value.astype(np.uint8)


def stamp_ink(rgb: np.ndarray) -> np.ndarray:
    """Blue or red ink, neither pale nor glaring; only the points that have colour are looked at."""
    r, g, b = (np.ascontiguousarray(rgb[..., k]) for k in range(3))
    value, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    inked = (value >= 30) & (value <= 220) & (value > low)
    h, s, _ = hue(rgb[inked])
    inked[inked] = ((h >= 85) & (h <= 135) & (s >= 60)) | (((h <= 10) | (h >= 165)) & (s >= 70))
    return inked


def dark_strokes(plane: np.ndarray, block: int = 25, darker: int = 12) -> np.ndarray:
    """Points at least ``darker`` levels below the Gaussian mean of their ``block``."""
    r, sigma = block // 2, 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    weight = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    weight /= weight.sum()
    wide = np.pad(plane.astype(np.float64), r, mode="edge")
    rows = sum(w * wide[k : k + plane.shape[0]] for k, w in enumerate(weight))
    mean = np.rint(sum(w * rows[:, k : k + plane.shape[1]] for k, w in enumerate(weight))).astype(np.int32)
    return plane.astype(np.int32) - mean <= -darker


def ellipse(size: int) -> list[int]:
    """Half widths of the rows of a round brush of odd ``size``."""
    r = size // 2
    return [round(r * math.sqrt((r * r - d * d) / (r * r))) for d in range(-r, r + 1)]


def closed(mask: np.ndarray, half_widths: list[int], times: int = 1) -> np.ndarray:
    """Dilation ``times`` times, then erosion, by a brush of rows of the given half widths; what lies outside has no say. Only
    points within twice the brush's reach of the mask have one."""
    reach = 2 * times * max(len(half_widths) // 2, *half_widths)
    rows, columns = _span(mask, 0, reach), _span(mask, 1, reach)
    whole, mask = np.zeros_like(mask), mask[rows, columns]

    def spread(image):
        out, r = np.zeros_like(image), len(half_widths) // 2
        run = np.pad(image, ((0, 0), (1, 0))).cumsum(axis=1, dtype=np.int32)
        x = np.arange(image.shape[1])
        wide = {w: run[:, np.minimum(x + w + 1, len(x))] > run[:, np.maximum(x - w, 0)] for w in set(half_widths)}
        for k, w in enumerate(half_widths):
            d, n = k - r, len(image)
            if abs(d) < n:
                out[max(0, d) : n + min(0, d)] |= wide[w][max(0, -d) : n + min(0, -d)]
        return out

    for _ in range(times):
        mask = spread(mask)
    lack = ~mask
    for _ in range(times):
        lack = spread(lack)
    whole[rows, columns] = ~lack
    return whole


def _span(mask: np.ndarray, axis: int, more: int = 0) -> slice:
    """The rows (``axis`` 0) or columns that hold points, and ``more`` on either side."""
    on = np.flatnonzero(mask.any(axis=1 - axis))
    return slice(max(0, int(on[0]) - more), int(on[-1]) + 1 + more) if len(on) else slice(0, 0)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each horizontal run."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def run_labels(row: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> np.ndarray:
    """The smallest run of each run's component; runs of neighbouring rows touch if they overlap, widened by ``reach``
    (1: corners count, 0: sides only)."""
    n = len(row)
    wide = int(last.max(initial=0)) + 3
    start, end = row * wide + first, row * wide + last
    low = np.searchsorted(end, start - wide - reach, side="left")
    high = np.searchsorted(start, end - wide + reach, side="right")
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    ok = row[b] == row[a] - 1
    a, b = a[ok], b[ok]
    parent = np.arange(n)
    while len(a):
        x, y = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not (parent[parent] == parent).all():
            parent = parent[parent]
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    return parent


def border(mask: np.ndarray, y: int, x: int) -> list[tuple[int, int]]:
    """(y, x) of the outer border of the component of its first point in reading order, once around."""
    steps = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))  # clockwise on the screen
    framed = np.pad(mask, 1)
    wide, on = framed.shape[1], framed.tobytes()
    moves = [dy * wide + dx for dy, dx in steps]
    at = (y + 1) * wide + x + 1

    def onward(at, back):
        for k in range(1, 9):
            d = (back + k) % 8
            if on[at + moves[d]]:
                return d
        return None

    d = onward(at, 0)
    path = [at]
    begin = d
    while d is not None:
        at += moves[d]
        d = onward(at, (d + 4) % 8)
        if at == path[0] and d == begin:
            break
        path.append(at)
    return [(p // wide - 1, p % wide - 1) for p in path]


def outlines(mask: np.ndarray, least_side: tuple[int, int] = (1, 1)) -> list[tuple[int, int, int, int, float, float]]:
    """x, y, w, h, area and arc of the outer outline of each component (corners touch) that lies in no hole of another, in
    reading order of its first point; components with boxes smaller than ``least_side`` (w, h) are left out."""
    rows, columns = _span(mask, 0), _span(mask, 1)
    mask = mask[rows, columns]  # beyond it there is ground only
    row, first, last = runs(mask)
    if not len(row):
        return []
    label = run_labels(row, first, last, 1)
    # the ground outside: runs of the empty points, with a frame around, that touch the frame by their sides
    g_row, g_first, g_last = runs(np.pad(~mask, 1, constant_values=True))
    g_label = run_labels(g_row, g_first, g_last, 0)
    wide = mask.shape[1] + 3
    found = []
    heads, inverse = np.unique(label, return_inverse=True)
    lo_x, hi_x, hi_y = np.full(len(heads), mask.shape[1]), np.zeros(len(heads), int), np.zeros(len(heads), int)
    np.minimum.at(lo_x, inverse, first)
    np.maximum.at(hi_x, inverse, last)
    np.maximum.at(hi_y, inverse, row)
    for k, head in enumerate(heads):
        y, x = int(row[head]), int(first[head])
        w, h = int(hi_x[k] - lo_x[k]) + 1, int(hi_y[k]) - y + 1
        if w < least_side[0] or h < least_side[1]:
            continue
        left = np.searchsorted(g_row * wide + g_first, (y + 1) * wide + x, side="right") - 1  # the run that ends before the point
        if g_label[left] != 0:
            continue
        path = np.array(border(mask, y, x))
        step = np.roll(path, -1, axis=0) - path
        area = abs(float((path[:, 1] * np.roll(path[:, 0], -1) - path[:, 0] * np.roll(path[:, 1], -1)).sum())) / 2
        arc = float(np.hypot(step[:, 0], step[:, 1]).sum())
        found.append((int(lo_x[k]) + columns.start, y + rows.start, w, h, area, arc))
    return found
