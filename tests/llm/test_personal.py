"""Problem 1: kinds found and placeholders put in, on hand-made texts."""

import pytest

from chatloom.llm.personal import masked, spans


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("写信给ａｂ＠example.net。", {"email"}),
        ("send it to lena dot w (at) example dot com", {"email"}),
        ("电话：１６１ ８３２６ ３８９３", {"phone"}),
        ("ring me on 0044 (0)20 7946 0380", {"phone"}),
        ("身份证号191322195301255364，收件人屠素商。", {"id_number", "name"}),
        ("register me with id QQ 82 87 25 B", {"id_number"}),
        ("寄到南屿市槐荫里区百草大道24号云栖苑7栋940室", {"address"}),
        ("deliver to Flat 4, 96 coopers street", {"address"}),
        ("ask for Harrowgate, Barnaby", {"name"}),
        ("联系人：祁​牧之", {"name"}),
        ("@云朵 看一下，快递单 SF715742924859，订单号2025806051372746", set()),
        ("https://share.example/v/ae010681a 取件码 06-3-2484 12:54 ¥1926.50", set()),
        ("望舒书店打4折, Coopers Court Flats Guide 40", set()),
        ("", set()),
    ],
)
def test_kinds(text, kinds):
    assert {k for _, _, k in spans(text)} == kinds


def test_only_the_value_is_replaced():
    assert masked("好的，我的号码１６１８３２６３８９３。谢谢") == "好的，我的号码[PHONE]。谢谢"
    assert masked("我住北渡区梧桐巷39号，晚点见") == "我住[ADDRESS]，晚点见"
