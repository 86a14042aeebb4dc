"""A small source tree of our own for the scanner's tests."""

import os

FILES = {
    "a/Pump.hxx": "#pragma once\nclass Motor {\npublic:\n    void Start();\n    double Rpm() const;\nprivate:\n    double m_rpm;\n};\n",
    "a/Car.hxx": """#pragma once
#include "Pump.hxx"
namespace Shop {
// class Fake {};
const char* k = "class AlsoFake {";
class IPart {
public:
    virtual ~IPart() = default;
    virtual void fit(int x = 0) = 0;
};
struct Box { int n; };
class SHOP_API Car final : public IPart, private Base<Motor> {
public:
    Car();
    Motor& engine(const Tank& t, int n = 3);
    void fit(int x) override;
    class Seat { double w; };
private:
    std::unique_ptr<Motor> m_main;
    Tank m_tank;
    std::vector<Motor*> m_spare;
    Motor* m_lent = nullptr;
    Motor& m_ref;
    Box m_boxes[4];
    std::function<void(Motor)> m_call;
    MotorPtr m_alias;
    int a, b;
};
}
""",
    "a/Car.cxx": """#include "Car.hxx"
namespace Shop {
Car::Car() : m_main(new Motor()), m_ref(*m_lent) { Logger log; }
Motor& Car::engine(const Tank& t, int n) {
    auto p = std::make_shared<Valve>(3);
    Gauge::Read();
    int x = n * 2;
    return *static_cast<Motor*>(0);
}
}
void Ghost::walk(Motor m) { }
int free_function(Motor m) { return 1; }
""",
    "b/Tank.hpp": "using MotorPtr = std::shared_ptr<Motor>;\ntypedef Motor Machine;\nclass Tank { Machine* m_m; Handler h; };\nnamespace A { class Handler {}; }\nnamespace B { class Handler {}; }\nclass Forward;\n",
    "b/Boat.sch": "forward_declare class Motor;\n\nclass Boat {\n    superclass IPart\n\n    void Launch();\n\n    Motor* m_pMotor;\n    Tank m_tank;\n};\n",
    "vendor/x.hxx": "class Vendored {};\n",
    "b/latin.c": "// caf\xe9\nstruct Latin { int x; };\n",
    "b/readme.txt": "class No {};",
}

RELATIONS = {
    ("Boat", "implements", "IPart", "Shop::IPart", 4), ("Boat", "associates", "Motor", "Motor", 8), ("Boat", "composes", "Tank", "Tank", 9), ("Ghost", "depends", "Motor", "Motor", 11),
    ("Shop::Car", "depends", "Logger", None, 3), ("Shop::Car", "depends", "Motor", "Motor", 4), ("Shop::Car", "depends", "Tank", "Tank", 4), ("Shop::Car", "depends", "Valve", None, 5),
    ("Shop::Car", "depends", "Gauge", None, 6), ("Shop::Car", "implements", "IPart", "Shop::IPart", 12), ("Shop::Car", "inherits", "Base", None, 12), ("Shop::Car", "depends", "Motor", "Motor", 15),
    ("Shop::Car", "depends", "Tank", "Tank", 15), ("Shop::Car", "composes", "Motor", "Motor", 19), ("Shop::Car", "composes", "Tank", "Tank", 20), ("Shop::Car", "aggregates", "Motor", "Motor", 21),
    ("Shop::Car", "associates", "Motor", "Motor", 22), ("Shop::Car", "associates", "Motor", "Motor", 26), ("Tank", "associates", "Motor", "Motor", 3), ("Tank", "composes", "Handler", None, 3),
}


def make(root, files=None):
    for path, text in (files or FILES).items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w", encoding="latin-1") as f:
            f.write(text)
    return str(root)
