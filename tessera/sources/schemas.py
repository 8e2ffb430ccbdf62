"""Schemas of the tables that readers give."""

ERROR = "error struct<kind:string,message:string>"
RGB = "struct<r:int,g:int,b:int>"
GIF = f"path string, version string, width int, height int, global_palette array<{RGB}>, background_index int, aspect_ratio int, loop_count int, comments array<binary>, icc_profile binary, {ERROR}"
FRAMES = f"path string, frame int, delay_cs int, disposal string, left int, top int, w int, h int, interlaced boolean, user_input boolean, incomplete boolean, rgba binary, {ERROR}"
BMP_INFO = f"path string, width bigint, height bigint, top_down boolean, bits_per_pixel int, compression string, header string, palette_len int, masks array<bigint>, ppm_x int, ppm_y int, color_space bigint, {ERROR}"
BMP = BMP_INFO.replace(f", {ERROR}", f", has_alpha boolean, icc_profile binary, rgba binary, {ERROR}")
PAGE_FIELDS = (
    "big_tiff boolean, big_endian boolean, width bigint, height bigint, bits_per_sample array<int>, samples_per_pixel int, sample_format string, photometric string, compression string, planar string, "
    "tile_w bigint, tile_h bigint, rows_per_strip bigint, predictor int, orientation int, extra_samples array<int>, icc_profile binary, x_res double, y_res double, res_unit int, subfile_type bigint, page_no int, page_total int"
)
PAGE_INFO = f"path string, page int, {PAGE_FIELDS}, {ERROR}"
PAGES = f"path string, page int, {PAGE_FIELDS}, color string, sample_type string, samples binary, premultiplied boolean, incomplete boolean, {ERROR}"
TAGS = f"path string, page int, tag int, type int, count bigint, ints array<bigint>, floats array<double>, raw binary, {ERROR}"
CHUNKS = f"path string, page int, idx int, plane int, x0 int, y0 int, width int, rows int, offset bigint, byte_count bigint, {ERROR}"


def names(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out
