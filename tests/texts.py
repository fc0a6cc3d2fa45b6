"""Hand-written texts that reach every branch of the text gates: id, text, event date."""

TEXTS = [
    (1, "Analysts raised their price target for crude after OPEC announced a cut in July.", "2021-07-04"),
    (2, "Scott Hall (born 1958) is a retired wrestler known for his work in the ring.", "2021-04-11"),
    (3, "The central bank will raise rates and yields are expected to rise next month.", "2022-03-16"),
    (4, "Russia-Ukraine tensions hit Brent in February amid fears of supply loss.", "2022-02-24"),
    (5, "Demand growth forecast by OPEC was unchanged at 2.5 million barrels.", "2023-01-10"),
    (6, "Officials projecting a rally to reach 90 dollars by 2030.", "2024-05-01"),
    (7, "The International Energy Agency reported inventories fell 3.2 percent.", "2023-06-15"),
    (8, "Gold is a chemical element and is a precious metal.", "2020-08-06"),
    (9, "Shares fell after the company halted production and laid off 1200 workers.", "2019-11-20"),
    (10, "The rate was 1-3/4 to 2 percent and later 5.25 percent.", "2019-09-18"),
    (11, "", "2020-01-01"),
    (12, "Prices will go up over the coming days as WTI demand recovers.", "2021-01-05"),
    (13, "It could hit 100 dollars because traders anticipate the price would climb.", "2022-06-08"),
    (14, "The 2022 World Cup is a football tournament in Qatar.", "2022-11-20"),
    (15, "Recently the EU approved a ban in December following talks in Germany.", "2022-12-05"),
    (16, "Parity by 2026 and outlook for 2027 remain uncertain.", "2025-02-02"),
    (17, "Oil prices surged 4.5 percent on Monday, crude jumped.", "2021-10-04"),
    (18, "The valuation outlook improved; estimates for natural gas prices rose.", "2023-08-01"),
    (19, "UN and NATO officials resigned. Powell warned of inflation at 7.1 in US.", "2022-01-12"),
    (20, "Weather was mild in the region and stocks were ample.", "not a date"),
    (21, "Coronavirus cases rose 1,234.5 a day in March 2020.", "2020-03-20"),
    (22, "A drop in gas, due to fall further, was in line with 3/4 point moves.", "2023-03-03"),
]
